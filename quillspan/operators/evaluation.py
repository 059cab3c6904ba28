"""Further evaluation: alternative sets, filtered and sampled ranks, strata, reports and selection."""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.operators.metrics import discount, ideal_gain
from quillspan.session import materialize

FAR = 1_000_000_000
#: Slices by value in which ``nth_value`` counts.
SLICES = 64


def set_credits(run: DataFrame, sets: DataFrame, cuts: tuple[int, ...]) -> DataFrame:
    """(query_id, complete_k, primary_k, alternative_k, union_recall_k) of sets (query_id, set_id, doc_id, is_primary)."""
    placed = sets.join(run.select("query_id", "doc_id", "rank"), ["query_id", "doc_id"], "left").withColumn("rank", F.coalesce("rank", F.lit(FAR)))
    last = placed.groupBy("query_id", "set_id", "is_primary").agg(F.max("rank").alias("last"))
    best = last.groupBy("query_id").agg(F.min("last").alias("any"), F.min(F.when(F.col("is_primary"), F.col("last"))).alias("own"))
    union = placed.groupBy("query_id", "doc_id").agg(F.min("rank").alias("rank"))
    met = union.groupBy("query_id").agg(F.count("*").alias("n"), *(F.count_if(F.col("rank") <= k).alias(f"in_{k}") for k in cuts))
    columns = []
    for k in cuts:
        whole, own = (F.coalesce(F.col(c) <= k, F.lit(False)) for c in ("any", "own"))
        columns += [whole.alias(f"complete_{k}"), own.alias(f"primary_{k}"), (whole & ~own).alias(f"alternative_{k}"), (F.col(f"in_{k}") / F.col("n")).alias(f"union_recall_{k}")]
    return best.join(met, "query_id").select("query_id", *columns)


def filtered_ranks(sims: DataFrame, qrels: DataFrame) -> DataFrame:
    """(query_id, doc_id, rank, filtered, n_others) of every relevant document over all scores."""
    everyone = Window.partitionBy("query_id")
    marked = sims.join(qrels.distinct().withColumn("gold", F.lit(1)), ["query_id", "doc_id"], "left").withColumn("gold", F.coalesce("gold", F.lit(0)))
    order = everyone.orderBy(F.desc("score"), "doc_id")
    ranked = marked.withColumn("rank", F.row_number().over(order)).withColumn("better", F.sum("gold").over(order)).withColumn("n_others", F.count_if(F.col("gold") == 0).over(everyone))
    return ranked.where("gold = 1").select("query_id", "doc_id", "rank", (F.col("rank") - F.col("better") + 1).alias("filtered"), "n_others")


def mean_over_golds(ranks: DataFrame, cuts: tuple[int, ...] = (1, 10)) -> DataFrame:
    """(query_id, mrr, hits_k, recall_k): means over the golds, by filtered ranks; recall by all ranks."""
    r, f = F.col("rank"), F.col("filtered")
    hits = [F.avg((f <= k).cast("double")).alias(f"hits_{k}") for k in cuts]
    recall = [F.avg((r <= k).cast("double")).alias(f"recall_{k}") for k in cuts]
    return ranks.groupBy("query_id").agg(F.avg(1.0 / f).alias("mrr"), *hits, *recall)


def sampled_hits(rank: Column, n_others: Column, k: int, sample: int) -> Column:
    """The chance that a rank is at most ``k`` among ``sample`` - 1 of the other candidates."""
    above = (rank - 1) / n_others
    parts = [math.comb(sample - 1, i) * F.pow(above, F.lit(i)) * F.pow(1 - above, F.lit(sample - 1 - i)) for i in range(k)]
    return sum(parts[1:], parts[0])


def nth_value(rows: DataFrame, keys: list[str], value: str, share: float) -> DataFrame:
    """(keys…, value): the element at place floor(share * n) of the sorted values of a group.

    Rows are dealt out in slices by the range of values, which are counted, so that a window
    orders slices, and then the values of one slice only.
    """
    known = rows.where(F.col(value).isNotNull()).select(*keys, value)
    dealt = materialize(known.repartitionByRange(SLICES, *keys, value).withColumn("slice", F.spark_partition_id()), "slices")
    sizes = dealt.groupBy(*keys, "slice").agg(F.count("*").alias("here"))
    own = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    before = F.coalesce(F.sum("here").over(own.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    at = sizes.withColumn("before", before).withColumn("nth", F.floor(F.sum("here").over(own) * share))
    chosen = at.where((F.col("before") <= F.col("nth")) & (F.col("nth") < F.col("before") + F.col("here")))
    chosen = chosen.select(*(F.col(k).alias(f"key_{k}") for k in keys), F.col("slice").alias("key_slice"), (F.col("nth") - F.col("before")).alias("left"))
    same = [F.col(k).eqNullSafe(F.col(f"key_{k}")) for k in keys] + [F.col("slice") == F.col("key_slice")]
    met = dealt.join(chosen, functools.reduce(lambda a, b: a & b, same))
    return met.withColumn("at", F.row_number().over(own.orderBy(value)) - 1).where(F.col("at") == F.col("left")).select(*keys, value)


def gain_by_stratum(run: DataFrame, qrels: DataFrame, k: int) -> DataFrame:
    """(query_id, stratum, ndcg) over the golds (query_id, doc_id, stratum) of each stratum alone."""
    met = qrels.join(run.select("query_id", "doc_id", "rank").where(F.col("rank") <= k), ["query_id", "doc_id"], "left")
    sums = met.groupBy("query_id", "stratum").agg(F.count("*").alias("n"), F.sum(discount(F.col("rank"))).alias("dcg"))
    return sums.select("query_id", "stratum", (F.coalesce("dcg", F.lit(0.0)) / ideal_gain(F.col("n"), k)).alias("ndcg"))


def largest_moves(deltas: DataFrame, n: int) -> DataFrame:
    """(side, query_id, doc_id, move): the ``n`` largest improvements and losses of (query_id, doc_id, move); below zero is better."""
    best = deltas.where("move < 0").orderBy("move", "query_id", "doc_id").limit(n).select(F.lit("better").alias("side"), "query_id", "doc_id", "move")
    worst = deltas.where("move > 0").orderBy(F.desc("move"), "query_id", "doc_id").limit(n).select(F.lit("worse").alias("side"), "query_id", "doc_id", "move")
    return best.unionByName(worst)


def restrict_run(run: DataFrame, manifest: DataFrame) -> DataFrame:
    """The run of the queries of a manifest (query_id); an error if one has no row."""
    missing = manifest.select("query_id").distinct().join(run, "query_id", "left_anti").count()
    if missing:
        raise ValueError(f"{missing} queries of the manifest have no ranking")
    return run.join(manifest.select("query_id").distinct(), "query_id", "left_semi")


def transfer(cells: DataFrame, floors: DataFrame) -> DataFrame:
    """(source, in_domain, off_mean, retention, floor_delta, wins) of cells (source, target, value) and floors (target, value).

    A target's floor is the best of its untrained values; differences are taken by target
    before they are averaged.
    """
    floor = floors.groupBy("target").agg(F.max("value").alias("floor"))
    off = F.col("source") != F.col("target")
    met = cells.join(floor, "target", "left")
    delta = F.when(off, F.col("value") - F.col("floor"))
    out = met.groupBy("source").agg(F.avg(F.when(~off, F.col("value"))).alias("in_domain"), F.avg(F.when(off, F.col("value"))).alias("off_mean"), F.avg(delta).alias("floor_delta"), F.count_if(delta > 0).alias("wins"))
    return out.withColumn("retention", F.col("off_mean") / F.col("in_domain"))


def score_margin(scores: DataFrame, qrels: DataFrame) -> DataFrame:
    """(query_id, doc_id, score, rank, ties, margin) of relevant documents: competition rank, equal scores, lead over the best other."""
    marked = scores.join(qrels.distinct().withColumn("gold", F.lit(True)), ["query_id", "doc_id"], "left")
    everyone = Window.partitionBy("query_id")
    other = F.max(F.when(F.col("gold").isNull(), F.col("score"))).over(everyone)
    ranked = marked.withColumn("rank", F.rank().over(everyone.orderBy(F.desc("score")))).withColumn("ties", F.count("*").over(Window.partitionBy("query_id", "score")) - 1).withColumn("margin", F.col("score") - other)
    return ranked.where("gold").select("query_id", "doc_id", "score", "rank", "ties", "margin")


def tournament(run: DataFrame, schedule: list[tuple[int, int]], better: str = "value") -> DataFrame:
    """(query_id, doc_id, final): ranks after rounds of windows of (query_id, doc_id, rank, value).

    Each round cuts what is left, in order, into windows and keeps the best few of each.
    Survivors of later rounds come first, then those of earlier ones, then the rest, each in
    the order in which their round left them.
    """
    state = run.select("query_id", "doc_id", "rank", better, F.col("rank").alias("place"), F.lit(0).alias("round"), F.col("rank").alias("left_at"))
    for i, (window, keep) in enumerate(schedule, 1):
        live = F.col("round") == i - 1
        state = state.withColumn("win", F.when(live, F.floor((F.col("place") - 1) / window)))
        own = Window.partitionBy("query_id", "win").orderBy(F.desc(better), "doc_id")
        state = state.withColumn("nth", F.when(live, F.row_number().over(own))).withColumn("kept", live & (F.col("nth") <= keep))
        order = Window.partitionBy("query_id", "kept").orderBy("win", "nth")
        state = state.withColumn("place", F.when(F.col("kept"), F.row_number().over(order)).otherwise(F.col("place")))
        state = state.withColumn("left_at", F.when(F.col("kept"), F.col("place")).otherwise(F.col("left_at"))).withColumn("round", F.when(F.col("kept"), i).otherwise(F.col("round")))
        state = state.drop("win", "nth", "kept")
    return state.select("query_id", "doc_id", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("round"), "left_at")).alias("final"))


def calls_of(n_docs: Column, schedule: list[tuple[int, int]]) -> Column:
    """How many windows a schedule judges for a pool of a size."""
    calls, n = F.lit(0), n_docs
    for window, keep in schedule:
        windows = F.ceil(n / window)
        calls, n = calls + windows, F.least(n, windows * keep)
    return calls
