"""Matching of references to works, labels of pairs, and the status of gold sets."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from quillspan.functions.text import content_words
from quillspan.operators.components import connected_components

ACCEPT = 0.8
TIERS = ((0.95, "exact"), (0.8, "strong"), (0.62, "weak"))


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio of two strings, which SQL doesn't have."""
    return pd.Series([None if x is None or y is None else difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)])


def token_f(a: Column, b: Column, beta: float = 0.5) -> Column:
    """F of two distinct token arrays, precision weighing more for a beta below 1."""
    shared = F.size(F.array_intersect(a, b))
    p, r = shared / F.size(b), shared / F.size(a)
    return F.when(shared > 0, (1 + beta * beta) * p * r / (beta * beta * p + r)).otherwise(0.0)


def title_similarity(a: Column, b: Column) -> Column:
    """1 for equal titles; for short ones the sequence ratio, else the token F times .97."""
    x, y = content_words(a), content_words(b)
    return F.when(a == b, 1.0).when(F.least(F.size(x), F.size(y)) <= 4, sequence_ratio(a, b)).otherwise(0.97 * token_f(x, y))


def tier(score: Column) -> Column:
    out = F.when(score >= TIERS[0][0], TIERS[0][1])
    for least, name in TIERS[1:]:
        out = out.when(score >= least, name)
    return out.otherwise("none")


def corroboration(year_gap: Column, shared_authors: Column, shared_venue: Column) -> Column:
    """supports: a close year, an author or the venue; contradicts: far years and no author; else neutral."""
    return F.when((year_gap <= 2) | (shared_authors > 0) | shared_venue, "supports").when((year_gap >= 5) & (shared_authors == 0), "contradicts").otherwise("neutral")


def label_evidence(a: Column, b: Column, primary_a: Column, primary_b: Column) -> dict[str, Column]:
    """Shared fields, whether the primary ones are equal, and whether both sides have any."""
    return {"n_shared": F.size(F.array_intersect(a, b)), "primary_equal": primary_a == primary_b, "labelled": (F.size(a) > 0) & (F.size(b) > 0)}


def policy(name: str, n_shared: Column, primary_equal: Column, same_domain: Column) -> Column:
    """same or cross, under one of four policies."""
    disjoint = F.when(n_shared == 0, "cross").otherwise("same")
    return {
        "disjoint": disjoint,
        "overlap2": F.when(primary_equal | (n_shared >= 2), "same").otherwise("cross"),
        "primary": F.when(primary_equal, "same").otherwise("cross"),
        "domain_jump": F.when(same_domain.isNull(), disjoint).when((n_shared == 0) & ~same_domain, "cross").otherwise("same"),
    }[name]


def band(labelled: Column, n_shared: Column, primary_equal: Column) -> Column:
    """The graded scale; null without labels."""
    return F.when(~labelled, None).when(primary_equal, "same_primary").when(n_shared >= 2, "overlap_2plus").when(n_shared == 1, "overlap_1").otherwise("disjoint")


def query_slice(verdicts: DataFrame) -> DataFrame:
    """(query_id, slice): cross_involved with any cross gold, same_only if all are same, else unlabelled."""
    v = F.col("verdict")
    return verdicts.groupBy("query_id").agg(F.when(F.bool_or(F.coalesce(v == "cross", F.lit(False))), "cross_involved").when(F.bool_and(F.coalesce(v == "same", F.lit(False))), "same_only").otherwise("unlabelled").alias("slice"))


def set_status(members: DataFrame) -> DataFrame:
    """(query_id, n_sets, n_complete, status) of (query_id, set_id, resolved): several complete sets make alternatives."""
    sets = members.groupBy("query_id", "set_id").agg(F.bool_and("resolved").alias("complete"))
    out = sets.groupBy("query_id").agg(F.count("*").alias("n_sets"), F.count_if("complete").alias("n_complete"))
    return out.withColumn("status", F.when(F.col("n_complete") >= 2, "alternatives").when(F.col("n_complete") == 1, "unique").otherwise("unresolved"))


def same_works(works: DataFrame) -> DataFrame:
    """(id, work) of (id, title, authors): equal titles with a shared author, or without authors, are one work.

    Records of a title meet by it and a surname, or by it alone where one side has no
    authors; each links to the least record under its key, so that no pairs are made.
    """
    own = works.select("id", "title", F.col("authors"))
    by_author = own.select("id", "title", F.explode("authors").alias("who")).select("id", F.struct("title", "who").alias("k"))
    unsigned = own.where(F.size("authors") == 0).select(F.col("title").alias("t")).distinct()
    by_title = own.join(unsigned, F.col("title") == F.col("t")).select("id", F.struct("title", F.lit("").alias("who")).alias("k"))
    keyed = by_author.unionByName(by_title)
    least = keyed.groupBy("k").agg(F.min("id").alias("b"))
    met = connected_components(keyed.join(least, "k").select(F.col("id").alias("a"), "b"))
    return works.select("id").join(met, F.col("id") == F.col("node"), "left").select("id", F.coalesce("component", "id").alias("work"))
