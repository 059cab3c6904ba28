"""Evaluation of ranked runs against several relevant documents a query, and statistics."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CUTS = (1, 2, 3, 5, 10, 15, 20, 25, 50, 100)


def discount(rank: Column) -> Column:
    return 1.0 / F.log2(rank + 1.0)


def ideal_gain(n: Column, k: int) -> Column:
    """Gain of the best order of ``n`` relevant documents in the first ``k`` places."""
    gains = [0.0]
    for i in range(1, k + 1):
        gains.append(gains[-1] + 1 / math.log2(i + 1))
    return F.element_at(F.array(*map(F.lit, gains)), F.least(n, F.lit(k)).cast("int") + 1)


def per_query(run: DataFrame, qrels: DataFrame, cuts=CUTS, ndcg=(5, 10)) -> DataFrame:
    """One row a query of ``qrels``: mrr, mgrr, map, and recall, hits and ndcg at cut-offs.

    A relevant document outside the run adds 0. mrr is that of the first relevant document,
    mgrr the mean over all of them.
    """
    golds = qrels.distinct()
    n = golds.groupBy("query_id").agg(F.count("*").alias("n_golds"))
    hits = run.select("query_id", "doc_id", "rank").join(golds, ["query_id", "doc_id"])
    order = Window.partitionBy("query_id").orderBy("rank")
    hits = hits.withColumn("nth", F.row_number().over(order))
    sums = [F.min("rank").alias("first"), F.sum(1.0 / F.col("rank")).alias("rr"), F.sum(F.col("nth") / F.col("rank")).alias("ap")]
    sums += [F.sum((F.col("rank") <= k).cast("int")).alias(f"in_{k}") for k in cuts]
    sums += [F.sum(F.when(F.col("rank") <= k, discount(F.col("rank")))).alias(f"dcg_{k}") for k in ndcg]
    met = n.join(hits.groupBy("query_id").agg(*sums), "query_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return met.select(
        "query_id", "n_golds",
        zero(1.0 / F.col("first")).alias("mrr"), zero(F.col("rr") / F.col("n_golds")).alias("mgrr"), zero(F.col("ap") / F.col("n_golds")).alias("map"),
        *(zero(F.col(f"in_{k}") / F.col("n_golds")).alias(f"recall_{k}") for k in cuts),
        *(zero((F.col(f"in_{k}") > 0).cast("double")).alias(f"hits_{k}") for k in cuts),
        *(zero(F.col(f"dcg_{k}") / ideal_gain(F.col("n_golds"), k)).alias(f"ndcg_{k}") for k in ndcg),
    )


def complete_sets(run: DataFrame, sets: DataFrame, cuts=(2, 5, 10, 20, 50, 100)) -> DataFrame:
    """(query_id, complete_k…): whether some set of the query lies in the first k places whole."""
    placed = sets.join(run.select("query_id", "doc_id", "rank"), ["query_id", "doc_id"], "left")
    last = placed.groupBy("query_id", "set_id").agg(F.max(F.coalesce("rank", F.lit(1_000_000_000))).alias("last"))
    best = last.groupBy("query_id").agg(F.min("last").alias("best"))
    return best.select("query_id", *((F.col("best") <= k).cast("double").alias(f"complete_{k}") for k in cuts))


def slice_means(rows: DataFrame, slices: Column, metrics: list[str]) -> DataFrame:
    """Means of metrics by slice; a row counts for each of its slices."""
    return rows.withColumn("slice", F.explode(slices)).groupBy("slice").agg(F.count("*").alias("n"), *(F.avg(m).alias(m) for m in metrics))


def wilson(hits: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Bounds of a share's confidence interval."""
    p = hits / n
    mid, off = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return (mid - off) / (1 + z * z / n), (mid + off) / (1 + z * z / n)


def spearman(rows: DataFrame, x: str, y: str, key: str, eps: float = 1e-10) -> DataFrame:
    """(key, rho): correlation of ranks by group; ties share their mean rank."""

    def ranked(df: DataFrame, c: str) -> DataFrame:
        w = Window.partitionBy(key).orderBy(c)
        df = df.withColumn("_n", F.row_number().over(w))
        return df.withColumn(f"r_{c}", F.avg("_n").over(Window.partitionBy(key, c))).drop("_n")

    both = ranked(ranked(rows, x), y)
    a, b = f"r_{x}", f"r_{y}"
    return both.groupBy(key).agg((F.covar_pop(a, b) / ((F.stddev_pop(a) + eps) * (F.stddev_pop(b) + eps))).alias("rho"))


def auroc(rows: DataFrame, score: str, positive: str, key: str) -> DataFrame:
    """(key, auroc) from mean ranks, so that ties count half; null without both kinds."""
    w = Window.partitionBy(key).orderBy(score)
    r = rows.withColumn("_n", F.row_number().over(w)).withColumn("_r", F.avg("_n").over(Window.partitionBy(key, score)))
    p = F.sum(F.col(positive).cast("int"))
    n = F.count("*") - p
    top = F.sum(F.when(F.col(positive), F.col("_r"))) - p * (p + 1) / 2
    return r.groupBy(key).agg(F.when((p > 0) & (n > 0), top / (p * n)).alias("auroc"))


def poisson_steps(n: int = 12) -> list[float]:
    """The chances that a Poisson(1) number is at most 0, 1, 2, ..."""
    out, total, weight = [], 0.0, math.exp(-1)
    for i in range(n):
        total += weight
        weight /= i + 1
        out.append(total)
    return out


def bootstrap_differences(pairs: DataFrame, replicates: int, seed: int = 13) -> DataFrame:
    """(replicate, mean_diff) of resampled pairs (key, diff).

    Each pair is drawn a Poisson(1) number of times, by a digest of the seed, the replicate
    and the key, so that draws neither depend on the partitions nor need the rows together.
    """
    drawn = pairs.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("replicate").cast("string"), F.col("key").cast("string")))
    u = (F.conv(F.substring(digest, 1, 10), 16, 10).cast("double") + 0.5) / float(1 << 40)
    times = reduce(lambda a, b: a + b, ((u > p).cast("int") for p in poisson_steps()))
    return drawn.withColumn("t", times).groupBy("replicate").agg((F.sum(F.col("t") * F.col("diff")) / F.greatest(F.sum("t"), F.lit(1))).alias("mean_diff"))


def bradley_terry(games: DataFrame, rounds: int = 1000) -> list[tuple[str, float]]:
    """(arm, rating) of (a, b, points_a, n), one row a pair of arms; the mean rating is 1000.

    Only the table of pairs of arms reaches the driver; arms are the systems compared.
    """
    rows = [tuple(r) for r in games.select("a", "b", "points_a", "n").collect()]
    arms = sorted({x for r in rows for x in r[:2]})
    won = {x: sum(p if a == x else n - p for a, b, p, n in rows if x in (a, b)) for x in arms}
    strength = dict.fromkeys(arms, 1.0)
    for _ in range(rounds):
        strength = {x: max(won[x], 1e-9) / sum(n / (strength[a] + strength[b]) for a, b, _, n in rows if x in (a, b)) for x in arms}
        mean = math.exp(sum(map(math.log, strength.values())) / len(arms))
        strength = {x: s / mean for x, s in strength.items()}
    logs = {x: 400 * math.log10(s) for x, s in strength.items()}
    return [(x, 1000 + v - sum(logs.values()) / len(arms)) for x, v in logs.items()]
