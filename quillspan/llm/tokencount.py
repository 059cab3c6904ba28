"""Token counts with a digest cache."""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import chain

import pandas as pd
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.llm.decontaminate import sized
from quillspan.llm.text import arrow_schema, kept_in_worker, slices, split_join
from quillspan.session import materialize

CACHE_SCHEMA = "version string, digest binary, n_tokens long"
#: White space and what follows it up to the next white space: the pattern of byte-level files never cuts
#: a piece across the end of such a part. To the library U+001C to U+001F are no white space.
PARTS = re.compile("[^\\S\\x1c-\\x1f]*[\\S\\x1c-\\x1f]+|[^\\S\\x1c-\\x1f]+")
#: Occurrences in a slice of texts from which on a part's count is remembered, the longest such part, and how many a worker remembers.
OFTEN = 4
LONG_PART = 64
REMEMBERED = 200_000
#: Part of the version digest: raise it when counts of the same file would change.
RULES = "plain ids: no begin, end or added tokens; no truncation or padding; 1"


def tokenizer_version(name: str, payload: bytes) -> str:
    """Digest of the file, the library and the counting rules."""
    if name.endswith(".model"):
        from sentencepiece import __version__ as library
    else:
        from tokenizers import __version__ as library
    return hashlib.sha256(b"\0".join([payload, library.encode(), RULES.encode()])).hexdigest()


def counter(name: str, payload: bytes):
    """A function from a list of texts to their numbers of tokens."""
    if name.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_proto=payload)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    model = Tokenizer.from_buffer(payload)
    model.no_truncation()
    model.no_padding()
    whole = lambda texts: [len(x) for x in model.encode_batch_fast(texts, add_special_tokens=False)]
    return by_parts(whole) if parts_alone(json.loads(payload)) else whole


def parts_alone(spec: dict) -> bool:
    """Whether each of ``PARTS`` has the same tokens alone as in its text."""
    cut, tokens = spec.get("pre_tokenizer") or {}, spec.get("added_tokens") or []
    as_they_stand = all(not (t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"]) and not re.search(r"\s", t["content"]) for t in tokens)
    plain = cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space")
    return bool(plain and as_they_stand and spec["model"]["type"] == "BPE" and spec["model"].get("dropout") is None and not spec.get("normalizer") and not spec.get("post_processor"))


def by_parts(count: Callable[[list[str]], list[int]], most: int = REMEMBERED) -> Callable[[list[str]], list[int]]:
    """``count`` added up over the parts of a text: those met often are counted once, the others of a text together.

    What is left of a text without some of its parts has the same parts, for each begins
    with white space but the first.
    """
    known: dict[str, int] = {}

    def counts(texts: list[str]) -> list[int]:
        cut = [PARTS.findall(x) for x in texts]
        often = Counter(chain.from_iterable(cut))
        new = [x for x, n in often.items() if n >= OFTEN and len(x) <= LONG_PART and x not in known]
        if len(known) + len(new) > most:
            known.clear()
            new = [x for x, n in often.items() if n >= OFTEN and len(x) <= LONG_PART]
        known.update(zip(new, count(new)))
        rest = count(["".join([p for p in parts if p not in known]) for parts in cut])
        return [n + sum(map(known.__getitem__, filter(known.__contains__, parts))) for n, parts in zip(rest, cut)]

    return counts


def normaliser(name: str, payload: bytes) -> Callable[[str], str] | None:
    """What the tokenizer file itself makes of a text before it cuts it; None where it has no normalizer.

    Texts with one normalised content have one count. Strings of added tokens are found
    before, so that they stay as they are, between marks that tell them from text.
    """
    if name.endswith(".model"):
        return None
    from tokenizers import Tokenizer

    model = Tokenizer.from_buffer(payload)
    if model.normalizer is None:
        return None
    tokens = {t.content: i for i, t in model.get_added_tokens_decoder().items()}
    split = re.compile("(" + "|".join(map(re.escape, sorted(tokens, key=len, reverse=True))) + ")").split if tokens else lambda x: [x]
    normalise = model.normalizer.normalize_str
    return lambda text: "".join(f"\0{tokens[x]}\0" if i % 2 else normalise(x).replace("\0", "\0\0") for i, x in enumerate(split(text)))


def digest_column(name: str, payload: Broadcast, text: Column) -> Column:
    """Digest of a text's normalised content."""
    if normaliser(name, payload.value) is None:
        return F.unhex(F.sha2(text, 256))

    @F.pandas_udf("binary")
    def digest(texts: pd.Series) -> pd.Series:
        normalise = normaliser(name, payload.value)
        return texts.map(lambda x: hashlib.sha256(normalise(x).encode()).digest())

    return digest(text)


def read_cache(spark: SparkSession, cache_dir: str, version: str) -> DataFrame:
    """Stored counts of this version; empty when nothing is stored yet."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{cache_dir}/version={version}")
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], "digest binary, n_tokens long")
    # Two jobs that missed the same text may both have stored it.
    return spark.read.schema("digest binary, n_tokens long").parquet(path.toString()).groupBy("digest").agg(F.first("n_tokens").alias("n_tokens"))


def count_tokens(
    docs: DataFrame,
    tokenizer_path: str,
    cache_dir: str,
    *,
    limit: int = 512,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Tokens of every whole text, looked up by digest and encoded only where missing.

    The cache is a table in ``cache_dir``, a folder that driver and executors share, with
    a folder for each version digest. Each call joins the digests of the distinct
    normalised contents to it, encodes the misses (one text a digest) and appends their
    counts; then all documents are joined to the cache. A task that is run again writes the
    same rows. Returns the id, n_bytes, n_tokens and over_limit. Null counts as the empty
    text; an empty table gives an empty result; repeated rows each get a row, and a digest
    with a large share of them isn't dealt out by key; columns other than the id and the
    text are not read.
    """
    spark = docs.sparkSession
    with open(tokenizer_path, "rb") as f:
        payload = f.read()
    name = os.path.basename(tokenizer_path)
    version = tokenizer_version(name, payload)
    shared = spark.sparkContext.broadcast(payload)
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(F.col(id_col).alias("id"), text.alias("text")).withColumn("digest", digest_column(name, shared, F.col("text")))
    rows = materialize(keyed.select("id", F.octet_length("text").cast("long").alias("n_bytes"), "digest"), "digests")
    by_digest = materialize(rows.groupBy("digest").agg(F.count("*").alias("copies")), "by-digest")
    misses = materialize(by_digest.join(read_cache(spark, cache_dir, version), "digest", "left_anti").select("digest"), "misses")
    n_misses = misses.count()
    texts = keyed.select("digest", "text")
    if n_misses < by_digest.count():
        texts = texts.join(sized(misses), "digest", "left_semi")
    texts = texts.groupBy("digest").agg(F.first("text").alias("text"))
    out = "digest binary, n_tokens long"
    arrow = arrow_schema(texts, out)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = None
        for batch in batches:
            count = count or kept_in_worker(("tokens", version), lambda: counter(name, shared.value))
            n = [k for part in slices(batch.column("text").to_pylist()) for k in count(part)]
            yield pa.RecordBatch.from_arrays([batch.column("digest").cast(arrow.field(0).type), pa.array(n, pa.int64())], schema=arrow)

    if n_misses:
        texts.mapInArrow(encode, out).write.mode("append").parquet(f"{cache_dir}/version={version}")
    known = by_digest.join(read_cache(spark, cache_dir, version), "digest")
    return split_join(rows, known, "digest", "copies").select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
