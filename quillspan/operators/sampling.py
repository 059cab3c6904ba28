"""Deterministic samples in the order of a seeded hash of the key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def draw(seed: int, key: str) -> Column:
    """A digest of the seed and the key, in whose order samples are drawn."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def first_by_hash(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """``n`` rows; a sample with the same seed and a smaller ``n`` lies in it."""
    return df.orderBy(draw(seed, key), key).limit(n)


def stratified(df: DataFrame, stratum: str, n: int, *, whole: tuple = (), key: str, seed: int = 0) -> DataFrame:
    """All rows of the ``whole`` strata and ``n`` of each other one."""
    w = Window.partitionBy(stratum).orderBy(draw(seed, key), key)
    kept = df.withColumn("_n", F.row_number().over(w)).where((F.col("_n") <= n) | F.col(stratum).isin(*whole))
    return kept.drop("_n")


def carve(queries: DataFrame, qrels: DataFrame, corpus: DataFrame, n_queries: int, n_docs: int, seed: int = 0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A smaller task: sampled queries, their relevant documents, and distractors up to ``n_docs``."""
    q = first_by_hash(queries, "query_id", n_queries, seed)
    r = qrels.join(q, "query_id", "left_semi")
    golds = r.select("doc_id").distinct()
    first = corpus.join(golds.withColumn("_gold", F.lit(0)), "doc_id", "left").orderBy(F.coalesce("_gold", F.lit(1)), draw(seed, "doc_id"), "doc_id").limit(n_docs).drop("_gold")
    return q, r.join(first, "doc_id", "left_semi"), first
