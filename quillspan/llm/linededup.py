"""Line dedup by a deletion-neighbourhood join: of lines within one edit the earliest stays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.llm.decontaminate import sized
from quillspan.llm.text import arrow_schema, free_name, release_memory, split_join
from quillspan.session import materialize

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)

#: A line's place: documents are ordered by id, those of one id by a hash of the text, which tells them apart.
PLACE = ("doc_id", "tag", "line_no")
LINES = "tag long, line_no int, digest binary, keys array<long>"
VARIANTS = "half long, variant long, place int, doc_id {0}, tag long, line_no int"


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def halves(line: str) -> Iterator[tuple[int, str]]:
    """(key, other half): hashed halves, one of which two lines within one edit share.

    With the shorter length of the pair cut in the middle, an edit leaves either the half
    before the cut or the one behind it as it is. The line may be the shorter or the
    longer one, by one code point. An edit lies in the other half.
    """
    for short in (len(line), len(line) - 1):
        cut = short // 2
        yield signed(xxhash.xxh64_intdigest(f"<{short}:{line[:cut]}".encode())), line[cut:]
        begin = len(line) - (short - cut)
        yield signed(xxhash.xxh64_intdigest(f">{short}:{line[begin:]}".encode())), line[:begin]


def deletion_hashes(part: str) -> np.ndarray:
    """Hashes of the part without each of its code points in turn, and last of the whole part.

    Sums over code points times powers of an odd number, modulo 2 ** 64, so that all
    variants take time in proportion to the part.
    """
    codes = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    codes = (codes + np.uint64(0x632BE5AB)) * MULTIPLIER
    codes ^= codes >> np.uint64(29)
    powers = np.cumprod(np.full(len(codes) + 1, MULTIPLIER, dtype=np.uint64))
    kept = np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes * powers[1:])])
    moved = np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes * powers[:-1])])
    return np.concatenate([kept[:-1] + (moved[-1] - moved[1:]), kept[-1:]]).view(np.int64)


def split_lines(text: str | None) -> list[str]:
    return (text or "").split("\n")


def tagged(docs: DataFrame, *, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("tag"), F.col(text_col).alias("text"))


def line_table(docs: DataFrame, *, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, tag, line_no, digest, keys): every line with a word, and keys of its halves."""
    out = f"doc_id {docs.schema[id_col].dataType.simpleString()}, {LINES}"
    texts = tagged(docs, id_col=id_col, text_col=text_col)
    arrow = arrow_schema(texts, out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, tag, text in zip(*(c.to_pylist() for c in batch.columns)):
                for n, line in enumerate(split_lines(text)):
                    if line := line.strip():
                        rows.append((i, tag, n, xxhash.xxh3_128_digest(line.encode()), [k for k, _ in halves(line)]))
                if len(rows) > 50_000:
                    yield columns(rows, arrow)
                    rows = []
            if rows:
                yield columns(rows, arrow)
        release_memory()

    return texts.mapInArrow(run, out)


def columns(rows: list[tuple], arrow: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*rows), arrow)], schema=arrow)


def candidate_lines(docs: DataFrame, wanted: DataFrame, *, id_col: str, text_col: str) -> DataFrame:
    """The place, keys and text of the wanted lines; ``wanted`` has their places and keys."""
    by_doc = wanted.groupBy("doc_id", "tag").agg(F.collect_list(F.struct("line_no", "keys")).alias("wanted"))
    by_doc = materialize(by_doc.select(F.col("doc_id").alias("of"), F.col("tag").alias("of_tag"), "wanted"), "wanted")
    same = F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("tag") == F.col("of_tag"))
    met = tagged(docs, id_col=id_col, text_col=text_col).join(sized(by_doc), same)
    met = met.select("doc_id", "tag", F.split("text", "\n", -1).alias("lines"), F.explode("wanted").alias("w"))
    line = F.regexp_replace(F.get("lines", F.col("w.line_no")), r"^[\s\x1c-\x1f\x85\p{Z}]+|[\s\x1c-\x1f\x85\p{Z}]+$", "")
    return met.select("doc_id", "tag", "w.line_no", "w.keys", line.alias("line")).dropDuplicates(list(PLACE))


def variant_table(lines: DataFrame) -> DataFrame:
    """(half, variant, place, doc_id, tag, line_no): deletion variants of the halves that edits may be in.

    ``place`` is that of the code point left out, from 0, or -1 for the whole half.
    """
    out = VARIANTS.format(lines.schema["doc_id"].dataType.simpleString())
    arrow = arrow_schema(lines, out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, tag, n, keys, line in zip(*(c.to_pylist() for c in batch.columns)):
                done = set()
                for key, part in halves(line):
                    if key in keys and key not in done:
                        done.add(key)
                        hashes = deletion_hashes(part)
                        m = len(hashes)
                        places = np.arange(m, dtype=np.int32)
                        places[-1] = -1
                        place = [pa.array([i] * m, arrow.field(3).type), pa.array(np.full(m, tag)), pa.array(np.full(m, n, np.int32))]
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(m, key)), pa.array(hashes), pa.array(places), *place], schema=arrow)

    return lines.select(*PLACE, "keys", "line").mapInArrow(run, out)


def near_links(variants: DataFrame) -> DataFrame:
    """(later, earlier): for each line the earliest line that a shared variant puts before it.

    Lines that share a variant and the place left out differ in that place alone, so the
    earliest of them stands for all. A line that equals another's variant is that line with
    one code point less. Both need one earliest line for each key, and no pairs.
    """
    order = F.struct(*PLACE)
    firsts = materialize(
        variants.groupBy("half", "variant", "place").agg(F.min(order).alias("earlier"), F.max(order).alias("last")), "variants"
    )
    whole = firsts.where("place < 0").select("half", "variant", F.col("earlier").alias("whole"), F.col("last").alias("last_whole"))
    shorter = firsts.where("place >= 0").groupBy("half", "variant").agg(F.min("earlier").alias("earlier"), F.max("last").alias("last"))
    both = materialize(whole.join(shorter, ["half", "variant"]), "lengths")
    same_place = firsts.where("place >= 0 AND earlier <> last").select("half", "variant", "place", "earlier")
    rows = variants.where("place >= 0").select("half", "variant", "place", order.alias("later"))
    replaced = rows.join(sized(same_place), ["half", "variant", "place"]).select("later", "earlier")
    inserted = rows.join(sized(both.select("half", "variant", F.col("whole").alias("earlier"))), ["half", "variant"]).select("later", "earlier")
    # Equal lines are one line here, so that a half and its key name at most one whole line.
    deleted = both.select(F.col("last_whole").alias("later"), "earlier")
    return replaced.unionByName(inserted).unionByName(deleted).where("earlier < later").groupBy("later").agg(F.min("earlier").alias("earlier"))


def duplicate_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(lines, dropped): dropped has (doc_id, tag, line_no, distance) of every line that goes.

    A line goes if an earlier line equals it (distance 0), or if it is the first of its
    copies and an earlier line is one insertion, deletion or replacement of a code point
    away (distance 1). White space around a line doesn't count. Variants meet under two
    hashes of 64 bits each.
    """
    lines = materialize(line_table(docs, id_col=id_col, text_col=text_col), "lines")
    order = F.struct(*PLACE)
    distinct = materialize(lines.groupBy("digest").agg(F.min(order).alias("at"), F.first("keys").alias("keys"), F.count("*").alias("n")), "distinct-lines")
    keyed = distinct.select("at", F.explode(F.array_distinct("keys")).alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    wanted = keyed.join(sized(materialize(shared, "shared")), "key").groupBy("at").agg(F.collect_set("key").alias("keys"))
    candidates = materialize(candidate_lines(docs, wanted.select("at.*", "keys"), id_col=id_col, text_col=text_col), "candidates")
    links = near_links(materialize(variant_table(candidates), "neighbourhoods"))
    text_of = candidates.select(order.alias("at"), "line")
    verified = (
        links.join(text_of.select(F.col("at").alias("later"), F.col("line").alias("x")), "later")
        .join(text_of.select(F.col("at").alias("earlier"), F.col("line").alias("y")), "earlier")
        .where(F.levenshtein("x", "y", 1) == 1)
        .select("later.*", F.lit(1).alias("distance"))
    )
    copies = split_join(lines.select("digest", *PLACE), distinct.where("n > 1").select("digest", "at", "n"), "digest", "n")
    return lines, copies.where(F.col("at") < order).select(*PLACE, F.lit(0).alias("distance")).unionByName(verified)


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the lines that repeat an earlier one, and n_lines, n_exact, n_near.

    Lines are ordered by document id, null first, then by a hash of the text, which orders
    documents of equal ids, then by place. All columns stay, whatever their names; the text
    has its remaining lines, joined by newlines. Lines without a word always stay. A null
    text stays null, an empty one empty; a document may lose all its lines and then has an
    empty text. Rows with equal ids and texts count as one document, so that all of them
    keep the same lines. Long lines take memory and time in proportion to their length. The
    new count columns take the place of any columns of those names; an empty table gives an
    empty result.
    """
    names = [c for c in docs.columns if c not in ("n_lines", "n_exact", "n_near")]
    _, dropped = duplicate_lines(docs, id_col=id_col, text_col=text_col)
    of, tag, drop = (free_name(docs, x) for x in ("drop_id", "drop_tag", "drop_lines"))
    near = F.collect_set(F.when(F.col("distance") == 1, F.col("line_no")))
    exact = F.collect_set(F.when(F.col("distance") == 0, F.col("line_no")))
    by_doc = dropped.groupBy(F.col("doc_id").alias(of), F.col("tag").alias(tag)).agg(F.struct(F.array_except(exact, near).alias("exact"), near.alias("near")).alias(drop))
    met = docs.select(names).join(by_doc, F.col(id_col).eqNullSafe(F.col(of)) & (F.xxhash64(text_col) == F.col(tag)), "left")
    lines, changed = F.split(F.col(text_col), "\n", -1), F.col(drop).isNotNull()
    kept = F.filter(lines, lambda x, i: ~F.array_contains(F.array_union(f"{drop}.exact", f"{drop}.near"), i))
    count = lambda c: F.when(changed, F.size(f"{drop}.{c}")).otherwise(0).cast("long").alias(f"n_{c}")
    text = F.when(changed, F.array_join(kept, "\n")).otherwise(F.col(text_col)).alias(text_col)
    n_lines = F.when(F.col(text_col).isNull(), 0).otherwise(F.size(lines)).cast("long").alias("n_lines")
    return met.select(*(text if c == text_col else F.col(c) for c in names), n_lines, count("exact"), count("near"))


def clean_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size_col: str = "n_chars") -> DataFrame:
    """``docs`` with the same columns and rows, without repeated lines; the size column, if there, is counted anew."""
    out = dedup_lines(docs, id_col=id_col, text_col=text_col)
    if size_col in docs.columns:
        out = out.withColumn(size_col, F.char_length(text_col).cast(docs.schema[size_col].dataType))
    return out.select(docs.columns)
