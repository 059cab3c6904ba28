"""The pipeline's stages take effect, and every query of the subpackage runs."""

import duckdb
import glob
import os

import pytest

import corpus_pipeline
from quillspan.llm import decontaminate, queries, simhash, toxicity
from quillspan.session import read_table
from tests.conftest import SMALL
from tests.test_queries import canon


def test_pipeline(spark):
    docs = read_table(spark, SMALL, "documents")
    columns, sizes = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SMALL).cache()
        if name == "toxicity":
            bad = {r.doc_id for r in toxicity.toxicity(docs, read_table(spark, SMALL, "labels")).collect() if r.predicted}
            assert {r.doc_id for r in out.collect()} == {r.doc_id for r in docs.collect()} - bad
        if name == "simhash":
            groups = simhash.near_duplicates(docs).collect()
            assert {r.doc_id for r in out.collect()} == {r.component_id for r in groups}
        if name == "decontamination":
            dirty = decontaminate.contamination(docs, read_table(spark, SMALL, "benchmark")).where("contaminated").collect()
            assert dirty and {r.doc_id for r in out.collect()} == {r.doc_id for r in docs.collect()} - {r.doc_id for r in dirty}
        assert name == "bpe" or out.columns == columns
        sizes.append(out.count())
        docs = out
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] == sizes[-2] == corpus_pipeline.run(spark, SMALL).count()


def test_stages_with_odd_rows(spark):
    """Null and repeated ids, null, empty and long texts, clashing columns and empty tables, through every stage."""
    line = "a line of prose that two documents have, but for one letter of it"
    texts = ["first text of its own, with words", None, "", line, line[:-1] + "s", "third text, unlike all others before it", "x" * 30_000, "copied words stand here", "copied words stand here"]
    ids = [None, None, None, None, 7, 7, 8, 9, 9]
    ddl = "doc_id long, text string, lang string, source string, n_chars long, __id string, drop_lines int, row_of_docs string, words string"
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), "k", n, "r", None) for n, (i, t) in enumerate(zip(ids, texts))], ddl)
    kept = {"toxicity": texts, "line_dedup": [*texts[:4], "", *texts[5:]], "simhash": ["", *texts[:1], line, line[:-1] + "s", *texts[5:8]], "decontamination": texts}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SMALL)
        assert stage(spark, docs.limit(0), SMALL).count() == 0
        if name == "bpe":
            assert sorted((r.doc_id is None, r.n_tokens == 0) for r in out.collect()) == sorted((i is None, not t) for i, t in zip(ids, texts))
            continue
        assert out.columns == docs.columns
        got = out.collect()
        assert sorted(r.text or "" for r in got) == sorted(t or "" for t in kept[name]), name
        assert {(r["__id"], r.row_of_docs) for r in got} == {("k", "r")} and len({r.drop_lines for r in got}) == len(got)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{SMALL}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    got, want = queries.QUERIES[name](spark, SMALL), con.sql(queries.ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert canon([tuple(r) for r in got.collect()], got.columns) == canon(want.fetchall(), want.columns)
