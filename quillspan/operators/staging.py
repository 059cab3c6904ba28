"""Staging of tasks: selection, merging of records, gates, labels of strata, prompts and checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pick_by_golds(qrels: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """The rows of queries with one of ``n`` sampled relevant documents; a smaller sample lies in a larger one."""
    from quillspan.operators.sampling import first_by_hash

    golds = first_by_hash(qrels.select("doc_id").distinct(), "doc_id", n, seed)
    return qrels.join(qrels.join(golds, "doc_id", "left_semi").select("query_id").distinct(), "query_id", "left_semi")


def first_long_texts(rows: DataFrame, least: int) -> DataFrame:
    """(key, text) of (key, pos, text): for each key the first text of at least ``least`` characters."""
    return rows.where(F.length("text") >= least).groupBy("key").agg(F.min_by("text", "pos").alias("text"))


def contaminated(items: DataFrame, works: DataFrame, layer: DataFrame) -> DataFrame:
    """(id, n_works, in_layer) of items (id, title): works (title, doi) of the same title, and whether one is in the layer (doi)."""
    marked = works.distinct().join(layer.select("doi").distinct().withColumn("hit", F.lit(True)), "doi", "left")
    by_title = marked.groupBy("title").agg(F.count("*").alias("n_works"), F.bool_or(F.coalesce("hit", F.lit(False))).alias("in_layer"))
    out = items.join(by_title, "title", "left")
    return out.select("id", F.coalesce("n_works", F.lit(0)).alias("n_works"), F.coalesce("in_layer", F.lit(False)).alias("in_layer"))


def gates_pass(necessity: Column, n: Column, *others: Column) -> Column:
    """Whether each of ``n`` members was judged once and found necessary, and all other verdicts are true; null is no."""
    judged = F.array_sort(F.transform(necessity, lambda x: x["index"].cast("long")))
    whole = judged == F.sequence(F.lit(0).cast("long"), n.cast("long") - 1)
    necessary = F.forall(necessity, lambda x: F.coalesce(x["necessary"], F.lit(False)))
    verdicts = reduce(lambda a, b: a & b, (F.coalesce(x, F.lit(False)) for x in others))
    return (n > 0) & F.coalesce(whole & necessary, F.lit(False)) & verdicts


def closure(draws: DataFrame) -> DataFrame:
    """(query_id, member, n, nth) of draws (query_id, member): members by how often they were drawn, then by name."""
    counts = draws.groupBy("query_id", "member").agg(F.count("*").alias("n"))
    return counts.withColumn("nth", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("n"), "member")))


def field_distance(rows: DataFrame, domains: DataFrame) -> DataFrame:
    """``rows`` with ``distance`` between the fields ``a`` and ``b``; ``domains`` has the (field, domain) learned so far."""
    one, two = (domains.groupBy("field").agg(F.min("domain").alias(f"domain_{c}")).withColumnRenamed("field", c) for c in "ab")
    met = rows.join(F.broadcast(one), "a", "left").join(F.broadcast(two), "b", "left")
    known = F.col("domain_a").isNotNull() & F.col("domain_b").isNotNull()
    far = F.when(~known, "cross_field_unknown_domain").when(F.col("domain_a") == F.col("domain_b"), "cross_field_same_domain").otherwise("cross_domain")
    distance = F.when(F.col("a").isNull() | F.col("b").isNull(), None).when(F.col("a") == F.col("b"), "same_field").otherwise(far)
    return met.withColumn("distance", distance).drop("domain_a", "domain_b")


def strata(src: Column, gold: Column, near: list[str], far: list[str]) -> dict[str, Column]:
    """The strata of a source and a gold by their groups, under the definitions that differ in what they leave out."""
    group = lambda c: F.when(c.isin(near), "near").when(c.isin(far), "far")
    a, b = group(src), group(gold)
    jump = (a == "near") & (b == "far")
    return {
        "near_only": F.when((a == "near") & (b == "near"), "same").when(jump, "cross"),
        "binary": F.when(F.coalesce(jump, F.lit(False)), "cross").otherwise("same"),
        "gold_only": F.when(b == "near", "same").when(b == "far", "cross"),
        "group_jump": F.when(a == b, "same").when(a != b, "cross"),
        "three_way": F.when((a == "far") & b.isNotNull(), "method").when((a == "near") & (b == "near"), "same").when(jump, "cross"),
    }


def stratum_of(relation: Column, distance: Column) -> Column:
    """same or cross from a relation under any of its spellings, else from an older distance; null without either."""
    same = relation.isin("same", "same_field", "same_domain")
    cross = relation.isin("cross", "cross_field", "cross_domain")
    old = F.when(distance.isin("same_field", "same_primary"), "same").when(F.coalesce(distance, F.lit("")) != "", "cross")
    return F.when(same, "same").when(cross, "cross").otherwise(old)


def legacy_metrics(rows: DataFrame) -> DataFrame:
    """``rows`` with mrr and mgrr: where mrr_best is given, it is mrr and the mrr of that row is mgrr; an error if both are."""
    if rows.where("mrr_best IS NOT NULL AND mgrr IS NOT NULL").limit(1).count():
        raise ValueError("rows with both mrr_best and mgrr are ambiguous")
    old = F.col("mrr_best").isNotNull()
    return rows.select(*(c for c in rows.columns if c not in ("mrr", "mgrr", "mrr_best")), F.when(old, F.col("mrr_best")).otherwise(F.col("mrr")).alias("mrr"), F.when(old, F.col("mrr")).otherwise(F.col("mgrr")).alias("mgrr"))


def resolve_once(rows: DataFrame, key: Column, resolve) -> DataFrame:
    """``rows`` with what ``resolve`` finds for each distinct key, a DataFrame (key) in and (key, …) out."""
    keyed = rows.withColumn("key", key)
    return keyed.join(resolve(keyed.select("key").where("key IS NOT NULL").distinct()), "key", "left")


def closest(rows: DataFrame, candidates: DataFrame) -> DataFrame:
    """(key, candidate) of rows (key, text) and their candidates (key, candidate, text): the least edit distance, ties by candidate.

    Edits stand for the sequence ratio, which the JVM has no function for.
    """
    met = rows.join(candidates.withColumnRenamed("text", "other"), "key")
    return met.groupBy("key").agg(F.min_by("candidate", F.struct(F.levenshtein("text", "other"), "candidate")).alias("candidate"))


def prompt_blocks(rows: DataFrame) -> DataFrame:
    """(query_id, prompt) of (query_id, kind, rank, name, value): "key: value" lines by kind, in order of rank."""
    line = F.concat("name", F.lit(": "), "value")
    blocks = rows.groupBy("query_id", "kind").agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))).alias("lines"))
    text = F.concat(F.col("kind"), F.lit("\n"), F.array_join(F.col("lines.line"), "\n"))
    return blocks.groupBy("query_id").agg(F.array_join(F.array_sort(F.collect_list(text)), "\n\n").alias("prompt"))


def consistency(ids: DataFrame, qrels: DataFrame, texts: DataFrame) -> DataFrame:
    """(check, n) of query rows (query_id), qrels (query_id, doc_id) and texts (doc_id, text): what a task has wrong."""
    per_query = qrels.join(texts.select("doc_id").distinct().withColumn("hit", F.lit(1)), "doc_id", "left").groupBy("query_id").agg(F.count("*").alias("n"), F.count("hit").alias("met"))
    checks = {
        "repeated_queries": ids.groupBy("query_id").count().where("count > 1"),
        "repeated_documents": texts.groupBy("doc_id").count().where("count > 1"),
        "queries_without_gold": ids.select("query_id").distinct().join(qrels, "query_id", "left_anti"),
        "missing_golds": qrels.select("doc_id").distinct().join(texts, "doc_id", "left_anti"),
        "partial_queries": per_query.where("met > 0 AND met < n"),
        "empty_texts": texts.where("text IS NULL OR trim(text) = ''"),
    }
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("check"), "n") for name, df in checks.items()]
    return reduce(DataFrame.unionByName, parts)


def cached_vectors(texts: DataFrame, encode, path: str, *, dims: int) -> DataFrame:
    """(text, v): vectors of the distinct texts (text), from the table at ``path`` or made by ``encode`` and appended to it.

    ``encode`` is (text) to (text, v). Vectors are cut to ``dims`` places and scaled to unit length.
    """
    from quillspan.functions.vectors import norm
    from quillspan.sources.files import append_new, exists

    spark = texts.sparkSession
    wanted = texts.select("text").distinct()
    if exists(spark, path):
        wanted = wanted.join(spark.read.parquet(path), "text", "left_anti")
    append_new(encode(wanted), path, "text")
    cut = spark.read.parquet(path).join(texts.select("text").distinct(), "text", "left_semi").select("text", F.slice("v", 1, dims).alias("v"))
    return cut.select("text", F.transform("v", lambda x: x / F.greatest(norm(F.col("v")), F.lit(1e-12))).alias("v"))
