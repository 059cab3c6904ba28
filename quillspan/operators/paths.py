"""Paths over typed edges: shortest ones, beams, validity, resolution and weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.operators.graph import both_ways, with_inverse
from quillspan.session import materialize


def shortest_paths(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(query_id, node, path): of the shortest undirected paths from a seed the first in order, as an array of nodes.

    Only the newest nodes go on, and each round keeps one path a node, so that the state
    grows with the nodes reached and not with the paths.
    """
    near = materialize(both_ways(edges).distinct(), "neighbours")
    front = materialize(seeds.distinct().select("query_id", "node", F.array("node").alias("path")), "front")
    seen = front
    for _ in range(depth):
        moved = front.join(near, front["node"] == near["src"]).select("query_id", F.col("dst").alias("node"), F.array_append("path", F.col("dst")).alias("path"))
        new = moved.join(seen.select("query_id", "node"), ["query_id", "node"], "left_anti").groupBy("query_id", "node").agg(F.min("path").alias("path"))
        front = materialize(new, "front")
        seen = seen.unionByName(front)
    return seen


def beam_paths(weights: DataFrame, starts: DataFrame, layers: int, beam: int) -> DataFrame:
    """(query_id, node, path, weight) of the best paths of ``layers`` hops over (layer, src, dst, w).

    Every layer keeps the ``beam`` paths of each query and node with the largest mean weight;
    ties go to the path first in order.
    """
    state = starts.distinct().select("query_id", "node", F.array("node").alias("path"), F.lit(0.0).alias("total"))
    for layer in range(1, layers + 1):
        own = weights.where(F.col("layer") == layer)
        moved = state.join(own, state["node"] == own["src"]).select("query_id", F.col("dst").alias("node"), F.array_append("path", F.col("dst")).alias("path"), (F.col("total") + F.col("w")).alias("total"))
        best = Window.partitionBy("query_id", "node").orderBy(F.desc(F.round("total", 9)), "path")
        state = materialize(moved.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= beam).drop("nth"), "beam")
    return state.select("query_id", "node", "path", (F.col("total") / layers).alias("weight"))


def path_checks(hops: DataFrame, seeds: DataFrame) -> DataFrame:
    """(path_id, n_hops, starts, chains, simple) of hops (path_id, hop, src, dst), hops from 1.

    Whether a path starts at a seed (path_id, node), each hop begins where the last one
    ended, and no node comes twice.
    """
    order = Window.partitionBy("path_id").orderBy("hop")
    linked = hops.withColumn("follows", F.col("src") == F.lag("dst").over(order))
    starts = hops.where("hop = 1").join(seeds.distinct().select("path_id", F.col("node").alias("src")), ["path_id", "src"], "left_semi").select("path_id").distinct().withColumn("starts", F.lit(True))
    nodes = hops.select("path_id", F.when(F.col("hop") == 1, F.array("src", "dst")).otherwise(F.array("dst")).alias("ns")).select("path_id", F.explode("ns").alias("node"))
    simple = nodes.groupBy("path_id").agg((F.count("*") == F.count_distinct("node")).alias("simple"))
    whole = linked.groupBy("path_id").agg(F.count("*").alias("n_hops"), F.bool_and(F.coalesce("follows", F.col("hop") == 1)).alias("chains"))
    return whole.join(starts, "path_id", "left").join(simple, "path_id").select("path_id", "n_hops", F.coalesce("starts", F.lit(False)).alias("starts"), "chains", "simple")


def resolved_paths(hops: DataFrame, edges: DataFrame, golds: DataFrame) -> DataFrame:
    """(path_id, resolved, senders): whether every hop (path_id, hop, src, rel, dst) is exactly one edge, one way or
    inverse, and the last one ends at a relevant node (path_id, node); senders are the distinct heads."""
    known = with_inverse(edges).groupBy("src", "rel", "dst").agg(F.count("*").alias("n"))
    met = hops.join(known, ["src", "rel", "dst"], "left")
    whole = met.groupBy("path_id").agg(F.bool_and(F.coalesce(F.col("n") == 1, F.lit(False))).alias("edges_known"), F.max_by("dst", "hop").alias("node"), F.count_distinct("src").alias("senders"))
    ends = golds.distinct().withColumn("ends", F.lit(True))
    out = whole.join(ends, ["path_id", "node"], "left")
    return out.select("path_id", (F.col("edges_known") & F.coalesce("ends", F.lit(False))).alias("resolved"), "senders")


def path_weights(hops: DataFrame, weights: DataFrame, n_layers: Column | None = None) -> DataFrame:
    """(path_id, weight): the mean over hops (path_id, hop, src, dst) of the largest weight (src, dst, w) of their edges; 0 for unknown ones."""
    best = weights.groupBy("src", "dst").agg(F.max("w").alias("w"))
    return hops.join(best, ["src", "dst"], "left").groupBy("path_id").agg(F.avg(F.coalesce("w", F.lit(0.0))).alias("weight"))


def prior_by_seed_set(seeds: DataFrame, prior) -> DataFrame:
    """(query_id, node, mass) by ``prior`` of seeds (query_id, node), worked out once for each distinct set of seeds."""
    sets = seeds.distinct().groupBy("query_id").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("node")), "\n"), 256).alias("set"))
    sets = materialize(sets, "seed-sets")
    first = sets.groupBy("set").agg(F.min("query_id").alias("first"))
    own = seeds.join(first.select(F.col("first").alias("query_id")), "query_id", "left_semi")
    found = prior(own).withColumnRenamed("query_id", "first")
    return sets.join(first, "set").join(found, "first").select("query_id", "node", "mass")
