"""One query for each operator of this subpackage, over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.llm import backoff, bpe, decontaminate, license, linededup, quality, simhash, suffixdedup, tokencount, toxicity
from quillspan.session import read_table, scratch_path


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license.scan(read_table(spark, sf_dir, "documents"))


def op2_simhash_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.scan(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two calls with one cache: the first encodes every distinct text, the second finds all counts stored."""
    docs, cache = read_table(spark, sf_dir, "documents"), scratch_path(spark, "token-cache")
    tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    tokencount.count_tokens(docs, tokenizer, cache)
    return tokencount.count_tokens(docs, tokenizer, cache)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = linededup.dedup_lines(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_exact", "n_near", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op7_backoff_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores are rounded, as sums of floating-point numbers depend on their order."""
    scored = backoff.backoff_scores(read_table(spark, sf_dir, "documents"))
    return scored.withColumns({"log_score": F.round("log_score", 4), "mean_log_score": F.round("mean_log_score", 6)})


def op8_quality_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(read_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "ratio", "n_chunks"
    )


def op9_bpe_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return bpe.digests(bpe.encode_decode(docs, public_tokenizers.path("word_bpe_49k.json")))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixdedup.digests(suffixdedup.remove_repeats(read_table(spark, sf_dir, "documents")))


QUERIES = {f.__name__: f for f in (op1_license_scan, op2_simhash_pivots, op3_toxicity, op4_decontamination, op5_token_counts, op6_line_dedup, op7_backoff_scores, op8_quality_bands, op9_bpe_lexicon, op10_suffix_dedup)}
ORACLE_SQL = {
    "op1_license_scan": license.sql(),
    "op4_decontamination": decontaminate.SQL,
    "op7_backoff_scores": backoff.sql(),
}
