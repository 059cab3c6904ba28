"""Nearest vectors by matrix products of blocks of queries and blocks of documents."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Vectors of a block; a product of two blocks is what a task holds at once.
BLOCK = 2048
#: Tasks that the blocks of one group are dealt out to.
SPREAD = 16


def blocks(vectors: DataFrame, size: int, by: Sequence[str]) -> DataFrame:
    """(by…, block, rows) of vectors (by…, id, v): groups are dealt out by a hash, in as many blocks as they need."""
    known = vectors.where("v IS NOT NULL")
    sizes = known.groupBy(*by).agg(F.count("*").alias("n_rows"))
    dealt = known.join(sizes, list(by)) if by else known.crossJoin(F.broadcast(sizes))
    number = F.pmod(F.xxhash64("id"), F.ceil(F.col("n_rows") / size))
    return dealt.select(*by, "id", "v", number.alias("block")).groupBy(*by, "block").agg(F.collect_list(F.struct("id", "v")).alias("rows"))


def unpacked(rows: pa.Array) -> tuple[pa.Array, np.ndarray]:
    ids, vs = rows.flatten().flatten()
    return ids, vs.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ids), -1)


def side_by_side(left: DataFrame, right: DataFrame, by: Sequence[str]) -> DataFrame:
    """Blocks of the same group: those of the left, with a number ``block``, are dealt out over ``SPREAD`` copies of the right."""
    parts = 4 * left.sparkSession.sparkContext.defaultParallelism
    one = left.withColumn("deal", F.pmod(F.xxhash64("block"), F.lit(SPREAD)))
    two = right.withColumn("deal", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SPREAD - 1).cast("long"))))
    return one.repartition(parts, *by, "deal").join(two.repartition(parts, *by, "deal").hint("shuffle_hash"), [*by, "deal"]).drop("deal")


def linked(vectors: DataFrame, least: float, by: str = "kind", size: int = BLOCK) -> DataFrame:
    """(a, b): pairs that connect the vectors (kind, id, v) of one kind just as all pairs with a dot product of ``least`` or more do.

    Each pair of blocks gives for its connected vectors their least one, so that there are
    no more rows than vectors a pair of blocks, however many pairs are near.
    """
    dealt = blocks(vectors, size, [by])
    left, right = dealt.withColumnRenamed("rows", "q"), dealt.select(by, F.col("block").alias("other"), F.col("rows").alias("d"))
    met = side_by_side(left, right, [by]).where("block <= other").select("q", "d")
    kind_of = vectors.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                (a, x), (b, y) = (unpacked(batch.column(batch.schema.get_field_index(c)).slice(i, 1)) for c in "qd")
                a, b = (z.to_numpy(zero_copy_only=False) for z in (a, b))
                near = (x @ y.T >= least) & ~np.equal.outer(a, b)
                ends, roots = [], []
                todo = near.any(axis=1)
                for start in np.flatnonzero(todo):
                    if not todo[start]:
                        continue
                    rows, seen, met_too = np.array([start]), np.zeros(len(a), dtype=bool), np.zeros(len(b), dtype=bool)
                    while len(rows):
                        seen[rows] = True
                        columns = np.flatnonzero(near[rows].any(axis=0) & ~met_too)
                        met_too[columns] = True
                        rows = np.flatnonzero(near[:, columns].any(axis=1) & ~seen)
                    todo[seen] = False
                    group = np.concatenate([a[seen], b[met_too]])
                    ends.append(group)
                    roots.append(np.full(len(group), group.min()))
                if ends:
                    one, two = np.concatenate(ends), np.concatenate(roots)
                    yield pa.RecordBatch.from_arrays([pa.array(z[one != two]) for z in (one, two)], names=["a", "b"])

    return met.mapInArrow(run, f"a {kind_of}, b {kind_of}")


def largest(scores: np.ndarray, k: int, least: float | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, columns, scores) of the ``k`` largest of each row with all ties, at ``least`` or above, rounded to 12 places.

    Of groups of columns only the largest are ordered: where ``k`` groups reach a bound, so
    do the ``k`` largest, and only what does is rounded and compared.
    """
    near = 1e-11
    bound = np.full((len(scores), 1), -np.inf if least is None else least - near)
    width = max(1, scores.shape[1] // (4 * k))
    groups = scores.shape[1] // width
    if groups > k:
        tops = scores[:, : groups * width].reshape(len(scores), groups, width).max(axis=2)
        bound = np.maximum(bound, np.partition(tops, groups - k, axis=1)[:, groups - k : groups - k + 1] - near)
    rows, columns = np.nonzero(scores >= bound)
    found = np.round(scores[rows, columns], 12)
    kept = found > -np.inf if least is None else found >= least
    rows, columns, found = rows[kept], columns[kept], found[kept]
    order = np.lexsort((-found, rows))
    begin = np.searchsorted(rows, np.arange(len(scores)))
    nth = np.minimum(begin + k, np.append(begin[1:], len(rows))) - 1
    kept = found >= found[order][nth[rows]] if len(rows) else kept[:0]
    return rows[kept], columns[kept], found[kept]


def nearest(queries: DataFrame, docs: DataFrame, k: int, *, by: Sequence[str] = (), least: float | None = None, same: bool = False, size: int = BLOCK) -> DataFrame:
    """(by…, query_id, doc_id, score, rank): the ``k`` largest dot products of each query, ties by id.

    Both sides are (by…, id, v). Each pair of blocks gives at most ``k`` rows a query (and
    ties), so that what is ranked at last grows with queries times blocks. With ``same``,
    a vector is not its own neighbour. Scores are rounded to 12 places, so that equal
    vectors tie. Null vectors are left out; groups of one side alone give no rows.
    """
    left, right = (blocks(x, size, by).select(*by, F.col("rows").alias(name)) for x, name in ((queries, "q"), (docs, "d")))
    met = side_by_side(left.withColumn("block", F.monotonically_increasing_id()), right, by).drop("block") if by else left.crossJoin(right)
    name_of = lambda df, c: df.schema[c].dataType.simpleString()
    out = ", ".join([*(f"{c} {name_of(queries, c)}" for c in by), f"query_id {name_of(queries, 'id')}", f"doc_id {name_of(docs, 'id')}", "score double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                (a, x), (b, y) = (unpacked(batch.column(batch.schema.get_field_index(c)).slice(i, 1)) for c in "qd")
                scores = x @ y.T
                if not (np.isfinite(x).all() and np.isfinite(y).all()):
                    scores[np.isnan(scores)] = -np.inf
                if same:
                    scores[np.equal.outer(a.to_numpy(zero_copy_only=False), b.to_numpy(zero_copy_only=False))] = -np.inf
                rows, columns, found = largest(scores, k, least)
                keys = [batch.column(j).slice(i, 1).take(pa.array(np.zeros(len(rows), dtype=np.int64))) for j in range(len(by))]
                yield pa.RecordBatch.from_arrays([*keys, a.take(pa.array(rows)), b.take(pa.array(columns)), pa.array(found)], names=[*by, "query_id", "doc_id", "score"])

    best = Window.partitionBy(*by, "query_id").orderBy(F.desc("score"), "doc_id")
    return met.mapInArrow(run, out).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
