"""Stupid-backoff language-model scores from n-gram count tables that are partitioned by hash.

Documents are gathered in blocks. A block sends each distinct n-gram of its documents once,
with its count there, to the bucket that the n-gram's hash names; buckets add up the counts
of all blocks and send them back; the block joins them to its exploded n-grams and sums by
document. Words come first and get numbers, so that longer n-grams travel as sorted numbers,
of which the differences are packed. An n-gram that holds a shorter one of which all copies
are in the block is known there already, and isn't sent.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.llm.text import arrow_schema
from quillspan.session import MAX_BUCKETS, bucketed

#: The longest n-grams; those that no other document holds back off to one word less, at this factor.
ORDER = 3
FACTOR = 0.4
#: Words of the documents of a block; whole documents go into it, so that the last one may exceed it.
BLOCK = 1 << 19
#: Words of the corpus, or distinct words summed over blocks, for each bucket of n-grams.
BUCKET = 1 << 20
#: Bytes of text whose blocks one task joins to their answers.
TASK = 16 << 20

REQUEST = "kind int, bucket long, block long, n int, keys binary, counts binary"
ANSWER = "block long, bucket long, n int, last long, counts binary"
BLOCKS = "block long, ids array<{0}>, sizes binary, tokens binary, n_words int, n_docs long, n_tokens long, words binary, counts binary"


def pack(arrays: list[np.ndarray]) -> bytes:
    """Unsigned numbers by planes of bytes, so that those that are mostly zero take no room."""
    flat = np.concatenate(arrays).astype("<u8")
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(flat.view(np.uint8).reshape(-1, 8).T).tobytes())


def unpack(data: bytes, n: int) -> list[np.ndarray]:
    """The arrays of ``pack``, of ``n`` numbers each."""
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8)
    flat = np.ascontiguousarray(raw.reshape(8, -1).T).view("<u8").ravel()
    return [flat[i : i + n] for i in range(0, len(flat), n)] if n else []


def bucket_of(lanes: list[np.ndarray], buckets: int) -> np.ndarray:
    mixed = np.zeros(len(lanes[0]), dtype=np.uint64)
    for lane in lanes:
        mixed = (mixed ^ lane) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return (mixed % np.uint64(buckets)).astype(np.int64)


def by_bucket(lanes: list[np.ndarray], buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, places) of keys, in the order in which they stand."""
    own = bucket_of(lanes, buckets)
    order = np.argsort(own, kind="stable")
    found, begins = np.unique(own[order], return_index=True)
    yield from zip(found.tolist(), np.split(order, begins[1:]))


def requests(kind: int, block: int, lanes: list[np.ndarray], counts: list[np.ndarray], buckets: int) -> Iterator[tuple]:
    """Rows of ``REQUEST`` for sorted keys in lanes; the first lane travels as differences."""
    if len(lanes[0]):
        for bucket, at in by_bucket(lanes, buckets):
            first = lanes[0][at]
            keys = pack([np.diff(first, prepend=first.dtype.type(0)), *(lane[at] for lane in lanes[1:])])
            yield kind, bucket, block, len(at), keys, pack([c[at] for c in counts])


def batches_of(rows: Iterator[tuple], arrow: pa.Schema, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Rows of packed columns in batches of about ``most`` bytes."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(x) for x in row if isinstance(x, bytes)) + 64
        if size >= most:
            yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*held), arrow)], schema=arrow)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*held), arrow)], schema=arrow)


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows one at a time, as blocks are large."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def block_table(docs: DataFrame, *, id_col: str, text_col: str, block: int) -> DataFrame:
    """One row a block: the ids and sizes of its documents, their words as places in ``words``.

    ``words`` has 96 bits of digest of the block's distinct words in order, with their
    counts and how many texts end with each; place 0 stands for the start of a text. Two
    words with one digest would count as one: odds of 10 ** -9 among 10 ** 10 words.
    """
    out = BLOCKS.format(docs.schema[id_col].dataType.simpleString())
    texts = docs.select(F.col(id_col), F.col(text_col))
    arrow = arrow_schema(texts, out)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        number, held, ids, sizes, places, local = TaskContext.get().partitionId() << 32, 0, [], [], [], {}

        def row():
            counts = np.array(sizes, dtype=np.int64)
            digests = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, local)), dtype=">u8").astype(np.uint64).reshape(-1, 2)
            digests[:, 1] >>= np.uint64(32)
            order = np.lexsort((digests[:, 1], digests[:, 0]))
            digests = digests[order]
            rank = np.zeros(len(order) + 1, dtype=np.int64)
            rank[order + 1] = np.arange(1, len(order) + 1)
            tokens = rank[np.concatenate([np.empty(0, np.int64), *places])]
            ends = tokens[np.cumsum(counts)[counts > 0] - 1]
            both = [np.bincount(x, minlength=len(rank))[1:] for x in (tokens, ends)]
            words = pack([np.diff(digests[:, 0], prepend=np.uint64(0)), digests[:, 1]])
            return number, list(ids), pack([counts]), pack([tokens]), len(order), int((counts > 0).sum()), len(tokens), words, pack(both)

        for batch in batches:
            for own, data in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                words = (data or b"").lower().split()
                ids.append(own)
                sizes.append(len(words))
                places.append(np.array([local.setdefault(w, len(local) + 1) for w in words], dtype=np.int32))
                held += len(words)
                if held >= block or len(ids) >= block:
                    yield row()
                    number, held, ids, sizes, places, local = number + 1, 0, [], [], [], {}
        if ids:
            yield row()

    return texts.mapInArrow(lambda batches: batches_of(rows(batches), arrow), out)


def digest_lanes(words: bytes, n: int) -> list[np.ndarray]:
    lanes = unpack(words, n) or [np.empty(0, np.uint64)] * 2
    return [np.cumsum(lanes[0], dtype=np.uint64), lanes[1]]


def word_requests(blocks: DataFrame, buckets: int) -> DataFrame:
    arrow = arrow_schema(blocks, REQUEST)

    def rows(batches):
        for row in rows_of(batches):
            if n := row["n_words"]:
                yield from requests(1, row["block"], digest_lanes(row["words"], n), unpack(row["counts"], n), buckets)

    return blocks.select("block", "n_words", "words", "counts").mapInArrow(lambda batches: batches_of(rows(batches), arrow), REQUEST)


def answers(asked: DataFrame, kind: int, buckets: int, tasks: int) -> DataFrame:
    """(block, answers): the counts over all blocks, for each request in its order; words also get their numbers, from 1.

    A bucket is the only place of its n-grams, and each block asks once for each, so that a
    frequent n-gram costs a row of its bucket for each block and no more.
    """
    dealt = asked.repartition("bucket").sortWithinPartitions("bucket")
    arrow = arrow_schema(asked, ANSWER)

    def answer(bucket: int, held: list[dict]) -> Iterator[tuple]:
        parts = [unpack(r["keys"], r["n"]) for r in held]
        lanes = [np.concatenate([np.cumsum(p[0], dtype=np.uint64) for p in parts]), *(np.concatenate(x) for x in zip(*(p[1:] for p in parts)))]
        del parts
        order = np.lexsort(lanes[::-1])
        new = np.zeros(len(order), dtype=bool)
        new[0] = True
        for lane in lanes:
            new[1:] |= np.diff(lane[order]) != 0
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.cumsum(new) - 1
        del lanes, order
        own = [unpack(r["counts"], r["n"]) for r in held]
        sums = []
        for which in range(2):
            total = np.zeros(int(new.sum()), dtype=np.int64)
            np.add.at(total, place, np.concatenate([o[which] for o in own]).astype(np.int64))
            sums.append(total)
        last = 0
        if kind == 1:
            # Frequent words get small numbers, which take less room in longer n-grams.
            numbers = np.empty(len(sums[0]), dtype=np.int64)
            numbers[np.argsort(-sums[0], kind="stable")] = 1 + bucket + buckets * np.arange(len(numbers))
            sums.append(numbers)
            last = int(numbers.max())
        at = 0
        for r in held:
            yield r["block"], bucket, r["n"], last, pack([s[place[at : at + r["n"]]] for s in sums])
            at += r["n"]

    def rows(batches):
        held = []
        for row in rows_of(batches):
            if held and held[-1]["bucket"] != row["bucket"]:
                yield from answer(held[0]["bucket"], held)
                held = []
            held.append(row)
        if held:
            yield from answer(held[0]["bucket"], held)

    found = dealt.mapInArrow(lambda batches: batches_of(rows(batches), arrow), ANSWER)
    gathered = found.repartition(tasks, "block").groupBy("block").agg(F.max("last").alias("last"), F.collect_list(F.struct("bucket", "n", "counts")).alias(f"answers{kind}"))
    return bucketed(gathered, f"answers-{kind}", "block", tasks)


def gather(found: list[dict] | None, lanes: list[np.ndarray], buckets: int, columns: int) -> list[np.ndarray]:
    """The answers of one kind, in the order of the keys that were asked for."""
    out = [np.zeros(len(lanes[0]), dtype=np.int64) for _ in range(columns)]
    rows = {r["bucket"]: r for r in found or ()}
    if len(lanes[0]):
        for bucket, at in by_bucket(lanes, buckets):
            for column, values in zip(out, unpack(rows[bucket]["counts"], rows[bucket]["n"])):
                column[at] = values
    return out


class Grams:
    """The n-grams of a block and their counts over all blocks, order by order."""

    def __init__(self, row: dict, buckets: dict[int, int], bits: int):
        self.row, self.buckets, self.bits = row, buckets, bits
        n_docs, n_words = len(row["ids"]), row["n_words"]
        self.sizes = unpack(row["sizes"], n_docs)[0].astype(np.int64)
        total, ends, numbers = gather(row["answers1"], digest_lanes(row["words"], n_words), buckets[1], 3)
        # Places follow the numbers from here on, so that n-grams sort by places as by numbers.
        order = np.argsort(numbers)
        rank = np.zeros(n_words + 1, dtype=np.int64)
        rank[order + 1] = np.arange(1, n_words + 1)
        n = int(self.sizes.sum())
        self.tokens = rank[unpack(row["tokens"], n)[0].astype(np.int64)] if n else np.empty(0, np.int64)
        self.numbers, self.word_counts = np.r_[0, numbers[order]], (total[order], ends[order])
        self.doc = np.repeat(np.arange(n_docs), self.sizes)
        self.within = np.arange(n) - (np.cumsum(self.sizes) - self.sizes)[self.doc]
        self.last = (np.cumsum(self.sizes) - 1)[self.doc]
        self.ends = np.unique(self.last)

    def longer(self, place: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """(place of each position's n-gram among the distinct ones in order, a position of each), from those of one word less."""
        key = self.tokens
        if place is not None:
            key = np.where(self.within > 0, np.r_[0, place[:-1] + 1], 0) * len(self.numbers) + key
        _, at, own = np.unique(key, return_index=True, return_inverse=True)
        return own, at

    def lanes(self, at: np.ndarray, order: int) -> list[np.ndarray]:
        """The n-grams at some positions as numbers, as many as fit side by side in 64 bits."""
        each = [np.where(self.within[at] >= t, self.numbers[self.tokens[np.maximum(at - t, 0)]], 0).astype(np.uint64) for t in range(order - 1, -1, -1)]
        side, out = max(1, 64 // self.bits), []
        for i in range(0, order, side):
            lane = each[i]
            for more in each[i + 1 : i + side]:
                lane = (lane << np.uint64(self.bits)) | more
            out.append(lane)
        return out

    def orders(self, upto: int) -> Iterator[tuple]:
        """(order, place, counts here, texts that end with it here, those to ask for, their lanes, counts, ends) up to an order."""
        place = alone = None
        for k in range(1, upto + 1):
            before = place
            place, at = self.longer(place)
            here, ends_here = np.bincount(place, minlength=len(at)), np.bincount(place[self.ends], minlength=len(at))
            n, ends, ask, lanes = here, ends_here, np.zeros(len(at), dtype=bool), []
            if k == 1:
                n, ends = (x[self.tokens[at] - 1] for x in self.word_counts)
            else:
                ask = ~(alone[before[at]] | (self.within[at] > 0) & alone[before[np.maximum(at - 1, 0)]])
                lanes = self.lanes(at[ask], k)
                if f"answers{k}" in self.row:
                    n, ends = here.copy(), ends_here.copy()
                    n[ask], ends[ask] = gather(self.row[f"answers{k}"], lanes, self.buckets[k], 2)
            alone = n == here
            yield k, place, here, ends_here, ask, lanes, n, ends

    def in_document(self, place: np.ndarray) -> np.ndarray:
        """How often the n-gram at each position stands in its document."""
        _, own, n = np.unique(self.doc * (int(place.max(initial=0)) + 1) + place, return_inverse=True, return_counts=True)
        return n[own]

    def scores(self, order: int, factor: float, n_tokens: int, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
        """Each position's logarithm, and whether it backed off."""
        context = np.maximum(n_tokens - self.sizes[self.doc], 1)
        s = np.log(factor**order / context)  # for words of no other document
        backed = np.ones(len(s), dtype=bool)
        for k, place, _, _, _, _, n, ends in self.orders(order):
            here = self.in_document(place)
            others = n[place] - here
            seen = others > 0
            s = np.where(seen, np.log(np.where(seen, others, 1) * factor ** (order - k) / np.where(seen, context, 1)), s)
            backed = ~seen
            # The next order's contexts: these n-grams one place before, where a word follows, in other documents.
            followed = (n - ends)[place] - (here - (place == place[self.last]))
            context = np.where(self.within > 0, np.r_[0, followed[:-1]], n_docs - 1)
        return s, backed


def gram_requests(joined: DataFrame, order: int, bits: int, buckets: dict[int, int]) -> DataFrame:
    arrow = arrow_schema(joined, REQUEST)

    def rows(batches):
        for row in rows_of(batches):
            *_, (k, _, here, ends, ask, lanes, _, _) = Grams(row, buckets, bits).orders(order)
            yield from requests(k, row["block"], lanes, [here[ask], ends[ask]], buckets[k])

    return joined.mapInArrow(lambda batches: batches_of(rows(batches), arrow), REQUEST)


def score_blocks(joined: DataFrame, order: int, bits: int, buckets: dict[int, int], factor: float, n_tokens: int, n_docs: int, out: str) -> DataFrame:
    arrow = arrow_schema(joined, out)

    def run(batches):
        for row in rows_of(batches):
            grams = Grams(row, buckets, bits)
            sums = [np.zeros(len(grams.sizes))] * 2
            if len(grams.tokens):
                sums = [np.bincount(grams.doc, weights=x, minlength=len(grams.sizes)) for x in grams.scores(order, factor, n_tokens, n_docs)]
            columns = [pa.array(row["ids"], arrow.field(0).type), pa.array(grams.sizes), pa.array(sums[1].astype(np.int64)), pa.array(sums[0])]
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return joined.mapInArrow(run, out)


def backoff_scores(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, factor: float = FACTOR, block: int = BLOCK, bucket: int = BUCKET
) -> DataFrame:
    """The id, n_tokens, n_backoff, log_score and mean_log_score of every document.

    Counts are those of all other documents, for a text's own would let it score itself. A
    word (lower-cased A-Z, between white space) scores count(n-gram) / count(context) if
    another document holds the n-gram of the ``order`` - 1 words before it and itself, else
    ``factor`` times the score with one word less before it, and so on to ``factor`` ** (order
    - 1) * count(word) / count of all words, and for a word of no other document ``factor``
    ** order / count of all words (1 if there are none). A context that begins before the
    text counts as one with the text's start. A document's score is the sum of the
    logarithms, and n_backoff the number of words that backed off at all. No n-gram is
    pruned. Texts without words (null, empty): counts 0, log_score 0, mean null. Each row is
    a document, repeated rows and null ids too, so that copies support each other. An empty
    table gives an empty result; columns other than the id and the text are not read. A very
    long text makes a block of its own size.
    """
    if order < 1:
        raise ValueError("order must be 1 or more")
    columns = {"id_col": id_col, "text_col": text_col}
    n_bytes = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    least = docs.sparkSession.sparkContext.defaultParallelism
    tasks = int(min(MAX_BUCKETS, max(2 * least, 1 + n_bytes // TASK)))
    blocks = bucketed(block_table(docs, **columns, block=block), "blocks", "block", tasks)
    n_keys, n_docs, n_tokens = (x or 0 for x in blocks.agg(F.sum("n_words"), F.sum("n_docs"), F.sum("n_tokens")).first())
    buckets = {k: int(max(least, 1 + (n_keys if k == 1 else n_tokens) // bucket)) for k in range(1, order + 1)}
    found = answers(word_requests(blocks, buckets[1]), 1, buckets[1], tasks)
    bits = max(1, (found.agg(F.max("last")).first()[0] or 0).bit_length())
    joined = blocks.drop("counts", "n_docs", "n_tokens").join(found.drop("last"), "block", "left")
    for k in range(2, order + 1):
        found = answers(gram_requests(joined, k, bits, buckets), k, buckets[k], tasks)
        joined = joined.join(found.drop("last"), "block", "left")
    out = f"id {docs.schema[id_col].dataType.simpleString()}, n_tokens long, n_backoff long, log_score double"
    scored = score_blocks(joined, order, bits, buckets, factor, n_tokens, n_docs, out)
    return scored.select(F.col("id").alias(id_col), "n_tokens", "n_backoff", "log_score", F.expr("CASE WHEN n_tokens > 0 THEN log_score / n_tokens END").alias("mean_log_score"))


def sql(factor: float = FACTOR) -> str:
    """The same for DuckDB, at order 3, with scores rounded as the query has them."""
    counts = ", ".join(
        f"count(*) OVER (PARTITION BY {keys}) - count(*) OVER (PARTITION BY r, {keys}) AS {name}"
        for name, keys in (("n3", "a, b, c"), ("x3", "a, b"), ("n2", "b, c"), ("x2", "b"), ("n1", "c"))
    )
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
t AS (SELECT r, CASE WHEN i > 2 THEN w[i - 2] END AS a, CASE WHEN i > 1 THEN w[i - 1] END AS b, w[i] AS c FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
n AS (SELECT r, {counts}, count(*) OVER () - count(*) OVER (PARTITION BY r) AS x1 FROM t),
s AS (SELECT r, n3 = 0 AS back, CASE WHEN n3 > 0 THEN ln(n3 / x3) WHEN n2 > 0 THEN ln({factor} * n2 / x2) WHEN n1 > 0 THEN ln({factor**2} * n1 / x1)
  ELSE ln({factor**3} / greatest(x1, 1)) END AS s FROM n),
g AS (SELECT r, count(*) AS n_tokens, count(*) FILTER (back) AS n_backoff, sum(s) AS log_score FROM s GROUP BY r)
SELECT doc_id, coalesce(n_tokens, 0)::BIGINT AS n_tokens, coalesce(n_backoff, 0)::BIGINT AS n_backoff,
  round(coalesce(log_score, 0), 4)::DOUBLE AS log_score, round(log_score / n_tokens, 6)::DOUBLE AS mean_log_score
FROM d LEFT JOIN g USING (r)
"""
