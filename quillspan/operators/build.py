"""Graph construction: consolidation, soft edges, seeding, merging, extraction and partitions.

Edges are (src, rel, dst); node names begin with their type in brackets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.functions.text import clean_phrase
from quillspan.functions.vectors import norm


def mean_vector(rows: DataFrame, keys: list[str], v: str = "v") -> DataFrame:
    """(keys…, mean): the mean of vectors by group, place by place, so that no group is gathered."""
    places = rows.select(*keys, F.posexplode(v).alias("place", "x")).groupBy(*keys, "place").agg(F.avg(F.col("x").cast("double")).alias("x"))
    ordered = places.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("place", "x"))).alias("xs"))
    return ordered.select(*keys, F.col("xs.x").alias("mean"))


def representatives(members: DataFrame) -> DataFrame:
    """(cluster, rep, size, centroid) of (cluster, id, name, weight, v).

    The member with the largest weight stands for a cluster, of several that with the
    shortest name, then the least id. The centroid is the mean at unit length.
    """
    best = F.max_by("id", F.struct("weight", -F.length("name"), -F.col("id")))
    named = members.groupBy("cluster").agg(best.alias("rep"), F.count("*").alias("size"))
    means = mean_vector(members, ["cluster"])
    unit = means.select("cluster", F.transform("mean", lambda x: x / norm(F.col("mean"))).alias("centroid"))
    return named.join(unit, "cluster")


def canonical(edges: DataFrame, canon: DataFrame) -> DataFrame:
    """Edges between the nodes that stand for their ends by ``canon`` (node, rep); loops and repeats go."""
    one, two = (canon.select(F.col("node").alias(c), F.col("rep").alias(f"{c}_rep")) for c in ("src", "dst"))
    met = edges.join(one, "src", "left").join(two, "dst", "left")
    out = met.select(F.coalesce("src_rep", "src").alias("src"), "rel", F.coalesce("dst_rep", "dst").alias("dst"))
    return out.where("src <> dst").distinct()


def soft_edges(pairs: DataFrame, signs: DataFrame, guarded: list[str]) -> DataFrame:
    """(src, rel, dst) of similar pairs (kind, a, b); in guarded kinds opposite signs (id, sign) keep apart."""
    one, two = (signs.select(F.col("id").alias(c), F.col("sign").alias(f"sign_{c}")) for c in "ab")
    met = pairs.join(one, "a").join(two, "b")
    kept = met.where(~F.col("kind").isin(guarded) | (F.col("sign_a") * F.col("sign_b") >= 0))
    return kept.select(F.col("a").alias("src"), F.concat(F.lit("similar_"), "kind").alias("rel"), F.col("b").alias("dst"))


def seeds_of_phrases(mentions: DataFrame, snapped: DataFrame) -> DataFrame:
    """(query_id, kind, node, score) of mentions (query_id, kind, phrase).

    ``snapped`` (kind, phrase, node, score) has the nodes of each distinct phrase, so that
    a phrase is looked up once however often it is mentioned; the best score counts.
    """
    return mentions.distinct().join(snapped, ["kind", "phrase"]).groupBy("query_id", "kind", "node").agg(F.max("score").alias("score"))


def hybrid_merge(frame: DataFrame, facts: DataFrame, mentions: DataFrame, seeds: DataFrame, docs: DataFrame, *, cap: int = 30, rel: str = "entity_in") -> DataFrame:
    """Edges of a frame graph with the entities of a fact graph that queries need.

    An entity stays if a query seeds it (query_id, node), it has at most ``cap`` facts, it is
    no node of the frame, and a mention (node, doc) names a known document (doc).
    """
    ends = lambda e: e.select(F.col("src").alias("node")).unionAll(e.select(F.col("dst").alias("node")))
    few = ends(facts).groupBy("node").agg(F.count("*").alias("degree")).where(F.col("degree") <= cap)
    known = mentions.join(docs.select("doc").distinct(), "doc", "left_semi").distinct()
    kept = seeds.select("node").distinct().join(few, "node", "left_semi").join(ends(frame).distinct(), "node", "left_anti").join(known, "node", "left_semi")
    named = known.join(kept, "node", "left_semi").select(F.col("node").alias("src"), F.lit(rel).alias("rel"), F.col("doc").alias("dst"))
    own = facts.join(kept.withColumnRenamed("node", "src"), "src", "left_semi").join(kept.withColumnRenamed("node", "dst"), "dst", "left_semi")
    return frame.select("src", "rel", "dst").unionByName(named).unionByName(own.select("src", "rel", "dst")).distinct()


def extracted_graph(triples: DataFrame) -> DataFrame:
    """(src, rel, dst) of triples (doc, pos, head, rel, tail), ``pos`` being their order.

    Phrases are cleaned; triples with an empty part go. The last relation of a head and a
    tail counts. Each entity is_mentioned_in its documents.
    """
    clean = triples.select("doc", "pos", *(clean_phrase(F.col(c)).alias(c) for c in ("head", "rel", "tail"))).where("head <> '' AND rel <> '' AND tail <> ''")
    facts = clean.groupBy("head", "tail").agg(F.max_by("rel", "pos").alias("rel")).select(F.col("head").alias("src"), "rel", F.col("tail").alias("dst"))
    named = clean.select(F.explode(F.array("head", "tail")).alias("src"), F.lit("is_mentioned_in").alias("rel"), F.col("doc").alias("dst")).distinct()
    return facts.unionByName(named)


def synonyms(near: DataFrame, least: float, most: int) -> DataFrame:
    """(src, rel, dst) 'equivalent' edges of near phrases (phrase, other, score).

    Scores are taken relative to a phrase's best. A phrase needs over two letters or digits
    and gets at most ``most`` + 1 neighbours, best first.
    """
    own = Window.partitionBy("phrase")
    scaled = near.withColumn("share", F.col("score") / F.max("score").over(own)).where(F.length(F.regexp_replace("phrase", "[^A-Za-z0-9]", "")) > 2)
    kept = scaled.where((F.col("phrase") != F.col("other")) & (F.col("share") >= least))
    nth = F.row_number().over(own.orderBy(F.desc("score"), "other"))
    return kept.withColumn("nth", nth).where(F.col("nth") <= most + 1).select(F.col("phrase").alias("src"), F.lit("equivalent").alias("rel"), F.col("other").alias("dst"))


def projection(edges: DataFrame, is_target) -> tuple[DataFrame, DataFrame]:
    """(edges between other nodes, (node, target) pairs): targets leave the graph and become a mapping."""
    src, dst = is_target(F.col("src")), is_target(F.col("dst"))
    pairs = edges.where(~src & dst).select(F.col("src").alias("node"), F.col("dst").alias("target")).unionByName(edges.where(src & ~dst).select(F.col("dst").alias("node"), F.col("src").alias("target")))
    return edges.where(~src & ~dst), pairs.distinct()


def boundaries(edges: DataFrame, part: Column, part_of_src: Column) -> DataFrame:
    """(part, n_edges, n_remote): edges by the part of their target, and distinct sources from other parts."""
    dealt = edges.select("src", part.alias("part"), part_of_src.alias("from_part"))
    return dealt.groupBy("part").agg(F.count("*").alias("n_edges"), F.count_distinct(F.when(F.col("part") != F.col("from_part"), F.col("src"))).alias("n_remote"))


def audit(nodes: DataFrame, edges: DataFrame, golds: DataFrame, is_document) -> DataFrame:
    """(check, n) of nodes (node), edges and relevant nodes (query_id, node): what a graph has wrong, in counts."""
    ends = edges.select(F.col("src").alias("node")).unionAll(edges.select(F.col("dst").alias("node"))).distinct()
    known = nodes.select("node").distinct()
    per_query = golds.join(known.withColumn("hit", F.lit(1)), "node", "left").groupBy("query_id").agg(F.count("*").alias("n"), F.count("hit").alias("met"))
    count = lambda name, df: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("check"), "n")
    checks = [
        count("nodes", nodes), count("repeated_nodes", nodes.groupBy("node").count().where("count > 1")), count("edges", edges),
        count("repeated_edges", edges.groupBy("src", "rel", "dst").count().where("count > 1")), count("loops", edges.where("src = dst")),
        count("dangling", ends.join(known, "node", "left_anti")), count("isolated_documents", known.where(is_document(F.col("node"))).join(ends, "node", "left_anti")),
        count("queries_without_gold", per_query.where("met = 0")), count("queries_with_part", per_query.where("met > 0 AND met < n")),
    ]
    out = checks[0]
    for check in checks[1:]:
        out = out.unionByName(check)
    return out


def information_gate(states: DataFrame, references: DataFrame, *, weight: float = 0.5) -> DataFrame:
    """(kind, id, gate) of states (kind, id, v): how far a state is from its kind's reference mean, as a gate.

    The distance's logarithm is centred and scaled over all states of a kind (a first pass);
    the gate is 1 - weight * (1 - sigmoid of that).
    """
    mean = mean_vector(references, ["kind"])
    squared = F.aggregate(F.zip_with("v", "mean", lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x)
    far = states.join(mean, "kind").select("kind", "id", F.log1p(squared).alias("far"))
    fit = far.groupBy("kind").agg(F.avg("far").alias("centre"), F.stddev_pop("far").alias("spread"))
    z = (F.col("far") - F.col("centre")) / (F.col("spread") + 1e-6)
    return far.join(fit, "kind").select("kind", "id", (1 - weight * (1 - 1 / (1 + F.exp(-z)))).alias("gate"))


def gate_policy(condition: str, gate: Column, protected: Column) -> Column:
    """The gate under a counterfactual: what lies on protected paths, or all but that, is left alone."""
    one = F.lit(1.0)
    changed = {"outside_full": gate, "outside_suppress": F.least(gate, one), "outside_amplify": F.greatest(gate, one)}
    if condition in changed:
        return F.when(protected, one).otherwise(changed[condition])
    return {"off": one, "frozen": gate, "path_only": F.when(protected, gate).otherwise(one)}[condition]
