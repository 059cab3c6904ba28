"""Near-duplicates by SimHash fingerprints, with pivot distance tables."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.llm.decontaminate import sized
from quillspan.llm.text import arrow_schema, free_name, map_texts, split_join
from quillspan.operators.components import connected_components
from quillspan.session import materialize

SHINGLE = 3
SEED = 42
BITS = 64
#: Fingerprints that differ in at most so many bits are linked.
DISTANCE = 3
#: Fingerprints that meet under one key are compared there up to this number.
BUCKET = 1024
#: Reference fingerprints: digests of the numbers from 0.
REFERENCES = np.array([xxhash.xxh64_intdigest(i.to_bytes(4, "little"), SEED) for i in range(32)], dtype=np.uint64)


def fingerprint(data: bytes, size: int = SHINGLE) -> int:
    """64 bits; each is set if it is set in over half of the shingles' hashes."""
    words = data.lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) < size:
        hashes = [digest(b" ".join(words), SEED)]
    else:
        hashes = [digest(b" ".join(t), SEED) for t in zip(*(words[i:] for i in range(size)))]
    found = np.zeros(BITS, dtype=np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = np.array(hashes[i : i + (1 << 16)], dtype="<u8").view(np.uint8).reshape(-1, 8)
        found += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(2 * found > len(hashes)).tolist())


def signed(value: int) -> int:
    return value - (1 << BITS) if value >> (BITS - 1) else value


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE) -> DataFrame:
    """The id and ``fp``, the fingerprint as a signed long, of every row."""
    return map_texts(docs, lambda data: (signed(fingerprint(data, size)),), "fp long", id_col=id_col, text_col=text_col)


def split_bits(bits: list[int], parts: int) -> list[int]:
    """Masks of ``parts`` runs of the given bits, of nearly equal size."""
    cuts = [round(i * len(bits) / parts) for i in range(parts + 1)]
    return [sum(1 << b for b in bits[x:y]) for x, y in zip(cuts, cuts[1:])]


def finer_masks(mask: int, blocks: int, distance: int) -> list[int]:
    """Masks over ``mask`` so that any two values that agree on it and differ in at most
    ``distance`` bits agree on one of them: all but ``distance`` of ``blocks`` blocks of the rest."""
    rest = split_bits([b for b in range(BITS) if not mask >> b & 1], blocks)
    return [mask | sum(c) for c in combinations(rest, blocks - distance)]


def pivot_key(fp: Column, mask: Column) -> Column:
    """A hash of the distances to all references, over the bits of a mask.

    Fingerprints that agree on the mask have equal coordinates there, so that none of their
    differences exceeds zero; others meet by chance only, and are verified like all.
    """
    return F.xxhash64(*(F.bit_count(fp.bitwiseXOR(F.lit(signed(int(r)))).bitwiseAND(mask)) for r in REFERENCES))


def near_pairs(fps: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links that join all values of one bucket that are within the distance of each other.

    The table has each value's distance to every reference. Two values within the distance
    have no coordinate that differs by more; a pair that has one is discarded, the others
    are verified. Only links that join two groups so far apart are returned.
    """
    table = np.bitwise_count(fps[:, None] ^ REFERENCES[None, :]).astype(np.int8)
    order = np.argsort(table[:, 0], kind="stable")
    fps, table = fps[order], table[order]
    # Sorted by the first coordinate, partners of a row stand before the first that exceeds it by more.
    ends = np.searchsorted(table[:, 0], table[:, 0] + distance, side="right")
    parent = list(range(len(fps)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    links = []
    for i in range(len(fps) - 1):
        near = table[i + 1 : ends[i]]
        left = np.flatnonzero(np.abs(near[:, 1:8] - table[i, 1:8]).max(axis=1, initial=0) <= distance)
        left = left[np.abs(near[left] - table[i]).max(axis=1, initial=0) <= distance] + i + 1
        for j in left[np.bitwise_count(fps[left] ^ fps[i]) <= distance].tolist():
            x, y = root(i), root(j)
            if x != y:
                parent[y] = x
                links.append((int(fps[i]), int(fps[j])))
    return links


def links_in_buckets(met: DataFrame, distance: int) -> DataFrame:
    """(a, b) from rows (mask, value, fp) that are sorted by mask and value in each partition."""
    out = "a long, b long"
    arrow = arrow_schema(met, out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def linked(keys: np.ndarray, fps: np.ndarray):
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            return [p for part in np.split(fps, cuts) if len(part) > 1 for p in near_pairs(part, distance)]

        def batch_of(pairs):
            both = np.array(pairs, dtype=np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], schema=arrow)

        keys, fps = np.empty((0, 2), np.int64), np.empty(0, np.uint64)
        for batch in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            keys = np.concatenate([keys, np.stack(cols[:2], axis=1)])
            fps = np.concatenate([fps, cols[2].view(np.uint64)])
            if len(keys):  # the last bucket may go on in the next batch
                whole = len(keys) - int((keys == keys[-1]).all(axis=1)[::-1].argmin() or len(keys))
                if pairs := linked(keys[:whole], fps[:whole]):
                    yield batch_of(pairs)
                keys, fps = keys[whole:], fps[whole:]
        if pairs := linked(keys, fps):
            yield batch_of(pairs)

    return met.mapInArrow(run, out)


def fingerprint_links(fps: DataFrame, *, distance: int = DISTANCE, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b) that join all distinct fingerprints within the distance of each other.

    The distance tables are made by blocks of bits. Values within the distance agree on all
    but ``distance`` of ``distance + 2`` blocks, so that over two blocks at least the largest
    difference of their coordinates is zero: each value goes under the coordinates of each
    choice of two blocks, and meets its partners under one of them. Buckets up to ``bucket`` values are compared there. Larger ones are
    dealt out again under keys with half of the remaining bits, and so on; after three
    such steps so few bits remain that buckets are small. No value is left out, and
    a bucket gives fewer links than it has values.
    """
    spark = fps.sparkSession
    keyed, masks, links = fps.select(F.lit(0).cast("long").alias("mask"), "fp"), [0], None
    for level in range(4):
        blocks = distance + 2 if not level else 2 * distance
        finer = {m: finer_masks(m, blocks, distance) for m in masks}
        table = spark.createDataFrame([(signed(m), [signed(x) for x in xs]) for m, xs in finer.items()], "mask long, finer array<long>")
        keyed = keyed.join(F.broadcast(table), "mask").select(F.explode("finer").alias("mask"), "fp")
        keyed = keyed.withColumn("value", pivot_key(F.col("fp"), F.col("mask")))
        shared = keyed.groupBy("mask", "value").agg(F.count("*").alias("n")).where("n > 1")
        met = materialize(keyed.join(sized(shared), ["mask", "value"]).select("mask", "value", "fp", "n"), "met")
        last = level == 3  # under 64 values agree on what a mask has by then
        few = met.where((F.col("n") <= bucket) | F.lit(last)).select("mask", "value", "fp")
        found = links_in_buckets(few.repartition("mask", "value").sortWithinPartitions("mask", "value"), distance)
        links = found if links is None else links.unionByName(found)
        keyed = met.where(F.col("n") > bucket).select("mask", "fp").distinct()
        if last or keyed.isEmpty():
            break
        hot = keyed.select("mask").distinct().collect()  # at most 10, 200 or 4,000 masks
        masks = [r.mask % (1 << BITS) for r in hot]
    return links


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, distance: int = DISTANCE, bucket: int = BUCKET) -> DataFrame:
    """The id, fingerprint (16 hex digits) and component_id of every document.

    The component id is the smallest id that links of at most ``distance`` bits reach.
    Texts without words (null, empty, white space) have fingerprint 0 and are linked like
    any other. Repeated rows and ties share their fingerprint's component. A null id
    stays null and never becomes a component id unless its component has no other. An
    empty table gives an empty result. Only the id and the text are read.
    """
    own = materialize(fingerprints(docs, id_col=id_col, text_col=text_col, size=size), "fingerprints")
    first = materialize(own.groupBy("fp").agg(F.min(id_col).alias("first_id"), F.count("*").alias("copies")), "distinct")
    links = materialize(fingerprint_links(first.select("fp"), distance=distance, bucket=bucket), "links")
    components = connected_components(links)
    named = first.join(sized(components.select(F.col("node").alias("fp"), "component")), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    named = materialize(named, "named")
    least = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    by_fp = materialize(named.join(least, "component").select("fp", "copies", "component_id"), "by-fingerprint")
    out = split_join(own.withColumnRenamed(id_col, "own_id"), by_fp, "fp", "copies")
    return out.select(F.col("own_id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` for each component: that with the smallest id.

    Null ids come last, so that a component whose ids are all null keeps a row too; of rows
    with the same id any one stays. Null and empty texts are one component. All columns stay,
    whatever their names; an empty table gives an empty result.
    """
    row = free_name(docs, "row_of_docs")
    tagged = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "tagged")
    key = F.struct(F.col(id_col).isNull().alias("unknown"), F.col(id_col).alias("id"), F.col(row).alias("row"))
    near = near_duplicates(tagged.select(key.alias("key"), F.col(text_col).alias("text")), id_col="key", text_col="text")
    kept = materialize(near.where(F.col("key") == F.col("component_id")).select(F.col("key.row").alias(row)), "kept")
    return tagged.join(sized(kept), row, "left_semi").select(docs.columns)
