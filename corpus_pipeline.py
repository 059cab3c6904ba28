"""The corpus pipeline over ``documents``; each stage rereads what the last one wrote."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quillspan.llm import bpe, decontaminate, linededup, simhash, toxicity
from quillspan.session import materialize, read_table


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator predicts as toxic go.

    Each row is judged by its text alone: null and repeated ids do no harm, null and empty
    texts stay, equal rows share a fate. Columns stay as they are; no documents give none.
    """
    return toxicity.keep_clean(docs, read_table(spark, sf_dir, "labels"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines within one edit of an earlier line go; no document does.

    Documents are ordered by id, null first, and those of one id by a hash of their texts;
    equal rows keep the same lines. A null text stays null. Columns stay, n_chars is counted
    anew; no documents give none.
    """
    return linededup.clean_documents(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked fingerprints the document with the smallest id stays.

    Null ids come last; of equal ids one row stays. Null and empty texts are one group.
    Columns stay as they are; no documents give none.
    """
    return simhash.keep_first(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that repeat test items in a twentieth of their words or more go.

    Each row is judged by its text alone: null and repeated ids do no harm, null and empty
    texts stay. Columns stay as they are; without documents or test items nothing goes.
    """
    return decontaminate.keep_clean(docs, read_table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded texts of what is left, a row for each row.

    Null and empty texts have no tokens; ids, null and repeated ones too, pass through; other
    columns are not read; no documents give none.
    """
    return bpe.digests(bpe.encode_decode(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES = [
    ("toxicity", reject_toxic),
    ("line_dedup", dedup_lines),
    ("simhash", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: SQL has no fitted classifier, 64-bit text fingerprints or tokenizers; tests compare each stage with brute force.
ORACLE_SQL = None
