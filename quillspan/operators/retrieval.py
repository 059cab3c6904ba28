"""Lexical retrieval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def term_counts(docs: DataFrame, id_col: str, tokens: Column) -> DataFrame:
    """(doc_id, term, tf)."""
    return docs.select(F.col(id_col).alias("doc_id"), F.explode(tokens).alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("tf"))


def bm25(docs: DataFrame, queries: DataFrame, tokenize, *, id_col: str = "doc_id", text_col: str = "text", k1: float = 1.5, b: float = 0.75, repeats: bool = True) -> DataFrame:
    """(query_id, doc_id, score) of documents that share a term with a query.

    idf is ln(1 + (n - df + .5) / (df + .5)); a query's repeated terms count repeatedly
    unless ``repeats`` is off. Queries (query_id, q_text) are matched by term, so that only
    postings of their terms are joined.
    """
    sized = docs.select(F.col(id_col).alias("doc_id"), tokenize(F.col(text_col)).alias("tokens"))
    lengths = sized.select("doc_id", F.greatest(F.size("tokens"), F.lit(1)).alias("len"))
    stats = lengths.agg(F.count("*").alias("n_docs"), F.avg("len").alias("avg_len"))
    wanted = queries.select("query_id", F.explode(tokenize(F.col("q_text"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
    terms = wanted.select("term").distinct()
    postings = sized.select("doc_id", F.explode("tokens").alias("term")).join(terms, "term", "left_semi").groupBy("doc_id", "term").agg(F.count("*").alias("tf"))
    df = postings.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avg_len")))
    times = F.col("qtf") if repeats else F.lit(1)
    weighted = postings.join(df, "term").join(lengths, "doc_id").crossJoin(F.broadcast(stats)).select("doc_id", "term", (idf * weight).alias("w"))
    return weighted.join(wanted, "term").groupBy("query_id", "doc_id").agg(F.sum(times * F.col("w")).alias("score"))
