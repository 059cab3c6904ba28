"""Exact removal of repeated byte strings by external induced suffix sorting of shards."""

from __future__ import annotations

import shutil
import tempfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.llm.decontaminate import sized
from quillspan.llm.inducedsort import repeats
from quillspan.llm.text import arrow_schema
from quillspan.session import MAX_BUCKETS, bucketed, materialize

LENGTH = 400
#: Bytes of the grams of which each string of ``LENGTH`` bytes has a least one, its anchor.
GRAM = 16
#: Distinct strings under a finer key beyond which it is made finer again.
HOT = 1_000
#: Starts under a finer key, level by level; with 1 start a key is the string itself.
PIECES = (128, 16, 1)
#: Rows of a table of keys or digests up to which it is broadcast.
BROADCAST_ROWS = 200_000
#: Bytes of a shard that is sorted at once (a single key may exceed it), and of a task.
SHARD = 2 << 20
TASK = 16 << 20
#: Starts that are looked at together, so that places fit in the low 20 bits.
CHUNK = 1 << 19
MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]

#: Bytes of the texts of a block, which stays in one place; bytes of the blocks that a task reads.
BLOCK = 4 << 20
BLOCKS_TASK = 32 << 20

RUNS = "block long, i int, start int, n int, anchor int, key long, content binary"


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the GRAM bytes at each place."""
    v = data.astype(np.uint64)
    for shift in (1, 2, 4):
        v = v[:-shift] | (v[shift:] << np.uint64(8 * shift))
    h = (v[:-8] * MIX[0]) ^ ((v[8:] + MIX[2]) * MIX[1])
    h ^= h >> np.uint64(31)
    h *= MIX[2]
    return h ^ (h >> np.uint64(29))


def runs_of(data: bytes, length: int) -> Iterator[tuple[int, int, int, int]]:
    """(start, n, anchor, key): runs of starts whose strings have the same anchor.

    The anchor is the place of the least gram hash in the string (the leftmost of equal
    ones). It depends on the string alone, so that equal strings have equal anchors, and
    their runs the same key.
    """
    width = length - GRAM + 1
    whole = np.frombuffer(data, dtype=np.uint8)
    for base in range(0, max(0, len(data) - length + 1), CHUNK):
        part = whole[base : base + CHUNK + length - 1]
        hashes = gram_hashes(part)
        low = np.uint64((1 << 20) - 1)
        ranked = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64)
        padded = np.concatenate([ranked, np.full(-len(ranked) % width, ~np.uint64(0))]).reshape(-1, width)
        forward = np.minimum.accumulate(padded, axis=1).ravel()
        backward = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
        n = len(hashes) - width + 1
        anchors = (np.minimum(backward[:n], forward[width - 1 : width - 1 + n]) & low).astype(np.int64)
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(anchors)) + 1, [n]])
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            anchor = int(anchors[a])
            yield base + a, b - a, base + anchor, int(hashes[anchor].view(np.int64))


def rows_to_batches(rows: Iterator[tuple], arrow: pa.Schema, most: int = 20_000) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == most:
            yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*held), arrow)], schema=arrow)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*held), arrow)], schema=arrow)


@dataclass
class Blocks:
    """A table (block, ids, texts) in as many buckets as tasks read it."""

    table: DataFrame
    tasks: int

    def with_rows(self, wanted: DataFrame, how: str = "inner") -> DataFrame:
        """The blocks with their rows of ``wanted`` as an array; texts stay where they are."""
        own = [c for c in wanted.columns if c != "block"]
        gathered = wanted.repartition(self.tasks, "block").groupBy("block").agg(F.collect_list(F.struct(*own)).alias("wanted"))
        return self.table.join(gathered, "block", how)


def text_blocks(docs: DataFrame, *, id_col: str, text_col: str) -> Blocks:
    """(block, ids, texts): the rows of ``docs`` in blocks, in buckets by block. A text is named by its block and place."""
    out = f"block long, ids array<{docs.schema[id_col].dataType.simpleString()}>, texts array<string>"
    texts = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")))
    arrow = arrow_schema(texts, out)

    def run(batches):
        number, size, parts = TaskContext.get().partitionId() << 32, 0, []

        def row():
            both = pa.Table.from_batches(parts).combine_chunks()
            lists = [pa.ListArray.from_arrays(pa.array([0, len(both)], pa.int32()), both.column(k).combine_chunks()).cast(arrow.field(k + 1).type) for k in range(2)]
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), *lists], schema=arrow)

        for batch in batches:
            ends = np.cumsum(pa.compute.binary_length(batch.column(1)).to_numpy(zero_copy_only=False).astype(np.int64))
            at = 0
            while at < batch.num_rows:
                done = int(ends[at - 1]) if at else 0
                to = min(batch.num_rows, 1 + int(np.searchsorted(ends, done + BLOCK - size)))
                parts.append(batch.slice(at, to - at))
                size += int(ends[to - 1]) - done
                at = to
                if size >= BLOCK:
                    yield row()
                    number, size, parts = number + 1, 0, []
        if parts:
            yield row()

    n_bytes = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    tasks = int(min(MAX_BUCKETS, max(2 * docs.sparkSession.sparkContext.defaultParallelism, 1 + n_bytes // BLOCKS_TASK)))
    return Blocks(bucketed(texts.mapInArrow(run, out), "texts", "block", tasks), tasks)


def each_text(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[bytes], list[dict]]]:
    """(block, texts, wanted) of one block at a time."""
    for batch in batches:
        for k in range(batch.num_rows):
            row = batch.slice(k, 1)
            data = row.column(row.schema.get_field_index("texts")).flatten().cast(pa.binary()).to_pylist()
            wanted = row.column(row.schema.get_field_index("wanted")).to_pylist()[0] if "wanted" in row.schema.names else None
            yield row.column(0)[0].as_py(), data, wanted or []


def first_runs(texts: Blocks, length: int) -> DataFrame:
    arrow = arrow_schema(texts.table, RUNS)

    def rows(batches):
        for block, data, _ in each_text(batches):
            for i, text in enumerate(data):
                for start, n, anchor, key in runs_of(text, length):
                    yield block, i, start, n, anchor, key, xxhash.xxh3_128_digest(text[start : start + n + length - 1])

    return texts.table.select("block", "texts").mapInArrow(lambda batches: rows_to_batches(rows(batches), arrow), RUNS)


def finer_runs(texts: Blocks, runs: DataFrame, piece: int, length: int) -> DataFrame:
    """The runs cut where the distance to the anchor passes a multiple of ``piece``.

    All strings of such a part hold the bytes from its last start to the end of its first
    string, which become part of the key: under a key only strings remain that are equal
    but for fewer than ``piece`` bytes at either end.
    """
    found = texts.with_rows(runs).drop("ids")
    arrow = arrow_schema(found, RUNS)

    def rows(batches):
        for block, whole, wanted in each_text(batches):
            for w in wanted:
                data, start, end, anchor = whole[w["i"]], w["start"], w["start"] + w["n"], w["anchor"]
                for r in range((anchor - end + 1) // piece, (anchor - start) // piece + 1):
                    least, most = anchor - (r + 1) * piece + 1, anchor - r * piece
                    a, b = max(start, least), min(end, most + 1)
                    key = xxhash.xxh64_intdigest(b"%d %d " % (w["key"], r) + data[most : max(most, least + length)])
                    key -= (key >> 63) << 64
                    yield block, w["i"], a, b - a, anchor, key, xxhash.xxh3_128_digest(data[a : b + length - 1])

    return found.mapInArrow(lambda batches: rows_to_batches(rows(batches), arrow), RUNS)


def sort_shards(strings: DataFrame, length: int, shard: int) -> DataFrame:
    """(block, i, start, n): runs of starts, in each text, whose bytes start elsewhere too.

    ``strings`` has (key, content, block, i, start, n, data), sorted by key and content in
    each partition. Strings of whole keys are gathered up to ``shard`` bytes in a file on
    disk, and its suffixes are sorted there; files are removed as soon as they are done with.
    """
    out = "block long, i int, start int, n int"
    arrow = arrow_schema(strings, out)

    def sort(rows: list[tuple], folder: str):
        path = f"{folder}/shard"
        with open(path, "wb") as f:
            for row in rows:
                f.write((np.frombuffer(row[6], np.uint8).astype(np.uint16) + np.uint16(1)).tobytes() + b"\0\0")
        met = repeats(np.memmap(path, dtype=np.uint16, mode="r"), length, folder)
        at = 0
        for _, _, block, i, start, n, data in rows:
            edges = np.flatnonzero(np.diff(np.r_[0, met[at : at + n].astype(np.int8), 0]))
            for a, b in edges.reshape(-1, 2).tolist():
                yield block, i, start + a, b - a
            at += len(data) + 1

    def rows(batches):
        folder = tempfile.mkdtemp(prefix="shard")
        try:
            held, size, last = [], 0, None
            for batch in batches:
                for row in zip(*(c.to_pylist() for c in batch.columns)):
                    if size >= shard and row[0] != last:
                        yield from sort(held, folder)
                        held, size = [], 0
                    held.append(row)
                    size += len(row[6])
                    last = row[0]
            if held:
                yield from sort(held, folder)
        finally:
            shutil.rmtree(folder, ignore_errors=True)

    return strings.mapInArrow(lambda batches: rows_to_batches(rows(batches), arrow), out)


def strings_of(texts: Blocks, wanted: DataFrame, length: int) -> DataFrame:
    """(key, content, block, i, start, n, data) of the wanted runs, dealt out and sorted by key."""
    found = texts.with_rows(wanted).drop("ids")
    out = "key long, content binary, block long, i int, start int, n int, data binary"
    arrow = arrow_schema(found, out)

    def rows(batches):
        for block, data, wanted in each_text(batches):
            for w in wanted:
                yield w["key"], w["content"], block, w["i"], w["start"], w["n"], data[w["i"]][w["start"] : w["start"] + w["n"] + length - 1]

    cut = found.mapInArrow(lambda batches: rows_to_batches(rows(batches), arrow, 2_000), out)
    total = wanted.agg(F.coalesce(F.sum(F.col("n") + F.lit(length - 1)), F.lit(0))).first()[0]
    return cut.repartition(max(1, 1 + total // TASK, texts.table.sparkSession.sparkContext.defaultParallelism), "key").sortWithinPartitions("key", "content")


def repeated_starts(texts: Blocks, length: int, hot: int, shard: int) -> DataFrame:
    """(block, i, start, n): runs of starts, in each text, of strings that start elsewhere too.

    Runs of equal bytes are one weighted string: all starts of all its copies repeat. One
    copy stands for them when a key has several contents and goes to the next level; what
    is found there for a string with several copies is known already.
    """
    place = ["block", "i", "start", "n"]
    runs, found = materialize(first_runs(texts, length), "runs"), None
    for level, piece in enumerate((*PIECES, None)):
        contents = materialize(runs.groupBy("key", "content").agg(F.count("*").alias("copies"), F.min(F.struct(*place, "anchor")).alias("at")), "contents")
        keys = materialize(contents.groupBy("key").agg(F.count("*").alias("k")).where("k > 1"), "keys")
        copied = runs.join(contents.where("copies > 1").select("key", "content"), ["key", "content"], "left_semi").select(place)
        found = copied if found is None else found.unionByName(copied)
        if piece is None:
            break
        if level:
            few = sized(keys.where(F.col("k") <= hot).select("key"), BROADCAST_ROWS)
            wanted = materialize(contents.join(few, "key", "left_semi").select(*(f"at.{c}" for c in place), "key", "content"), "strings")
            found = found.unionByName(materialize(sort_shards(strings_of(texts, wanted, length), length, shard), "sorted"))
        many = keys.where(F.col("k") > (hot if level else 1)).select("key")
        if many.isEmpty():
            break
        firsts = contents.join(sized(many, BROADCAST_ROWS), "key", "left_semi").select("at.*", "key")
        runs = materialize(finer_runs(texts, firsts, piece, length), "finer")
    return found


def joined_spans(runs: list[dict], length: int) -> dict[int, list[tuple[int, int]]]:
    """For each text of a block, the bytes under its runs of starts, as disjoint spans in order."""
    out: dict[int, list[tuple[int, int]]] = {}
    for i, begin, n in sorted((r["i"], r["start"], r["n"]) for r in runs):
        spans, end = out.setdefault(i, []), begin + n - 1 + length
        if spans and begin <= spans[-1][1]:
            spans[-1] = spans[-1][0], max(end, spans[-1][1])
        else:
            spans.append((begin, end))
    return out


def remove_repeats(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, hot: int = HOT, shard: int = SHARD
) -> DataFrame:
    """The id, n_bytes, ``spans`` (removed bytes, from begin up to end) and ``kept`` of every text.

    A byte goes if a string of ``length`` bytes that covers it starts at another place, in
    this or another document; strings are those of the input, and never cross documents.
    Every string is filed under the hash of its anchor gram, so that equal ones meet. A key
    with several contents is made finer; where several remain, suffixes are sorted in
    shards on disk. A finer key with more than ``hot`` contents is made finer again, twice
    at most, after which its strings are equal.
    ``kept`` is binary, as cuts may fall inside a character. Null and empty texts have no
    bytes. Texts stay in blocks in the shared folder; what is found travels to them. Long
    texts are looked at in chunks; repeated rows repeat each other's strings, and equal
    strings go wherever they stand, the first one too; null and equal ids do no harm; an
    empty table gives an empty result; columns other than the id and the text are not read.
    """
    if length < 2 * GRAM:
        raise ValueError(f"length must be at least {2 * GRAM}")
    texts = text_blocks(docs, id_col=id_col, text_col=text_col)
    found = repeated_starts(texts, length, hot, shard)
    out = f"{id_col} {docs.schema[id_col].dataType.simpleString()}, n_bytes long, spans array<struct<begin:long,end:long>>, kept binary"
    joined = texts.with_rows(found, "left").select("block", "texts", "wanted", "ids")
    arrow = arrow_schema(joined, out)

    def rows(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                ((_, whole, wanted),) = each_text([row])
                spans = joined_spans(wanted, length)
                for i, (own, data) in enumerate(zip(row.column(3).to_pylist()[0], whole)):
                    gone = spans.get(i, [])
                    kept = b"".join(data[a:b] for a, b in zip([0, *(b for _, b in gone)], [*(a for a, _ in gone), len(data)]))
                    yield own, len(data), [{"begin": a, "end": b} for a, b in gone], kept

    return joined.mapInArrow(lambda batches: rows_to_batches(rows(batches), arrow, 1_000), out)


def digests(cut: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """The id, n_bytes, n_removed, n_spans and kept_sha256."""
    return cut.select(
        id_col, "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )
