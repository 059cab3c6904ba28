"""Files are read and written as the data model has them; matching rules by hand."""

import hashlib
import json

import pytest

from quillspan.operators import resolution as R
from quillspan.sources import files as S
from pyspark.sql import functions as F


def test_corpus_and_queries(spark, tmp_path):
    (tmp_path / "d.json").write_text(json.dumps({"b": "B. two", "a": "A. one"}))
    assert [tuple(r) for r in S.read_corpus(spark, str(tmp_path / "d.json")).orderBy("pos").collect()] == [("b", 0, "B. two"), ("a", 1, "A. one")]
    (tmp_path / "q.json").write_text(json.dumps([{"id": "1", "question": "q?", "supporting_documents": ["a", "b", "a"], "more": {"x": 1}}]))
    assert [tuple(r) for r in S.qrels_of(S.read_queries(spark, str(tmp_path / "q.json"))).orderBy("gold_pos").collect()] == [("1", "a", 0), ("1", "b", 1)]


def test_jsonl_and_csv(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"k": 1}\n\n{broken\n{"k": 2}\n')
    assert sorted(r.k for r in S.read_jsonl(spark, str(tmp_path / "x.jsonl"), "k int").collect() if r.k) == [1, 2]
    (tmp_path / "n.csv").write_text('name,type,attributes\nNA,None,"{""a"": 1}"\nx,y,\n')
    nodes = S.read_csv(spark, str(tmp_path / "n.csv"), S.NODES)
    assert nodes.first()[:] == ("NA", "None", '{"a": 1}')
    S.require_unique(nodes, "name")
    with pytest.raises(ValueError):
        S.require_unique(nodes.union(nodes), "name")


def test_runs(spark, tmp_path):
    shapes = [{"id": "1", "predictions": {"document": [["d1", 0.5], ["d2", 0.25]]}}, {"id": "2", "predictions": {"document": ["d3", "d4"]}}, {"id": "3", "predictions": ["d5"]}]
    (tmp_path / "r.json").write_text(json.dumps(shapes))
    got = [tuple(r) for r in S.read_run(spark, str(tmp_path / "r.json")).orderBy("query_id", "rank").collect()]
    assert got == [("1", 1, "d1", 0.5), ("1", 2, "d2", 0.25), ("2", 1, "d3", None), ("2", 2, "d4", None), ("3", 1, "d5", None)]
    S.write_run(S.read_run(spark, str(tmp_path / "r.json")), str(tmp_path / "out"), 1)
    assert spark.read.json(str(tmp_path / "out")).count() == 3


def test_append_and_digests(spark, tmp_path):
    for n in (5, 8):
        S.append_new(spark.range(n).withColumnRenamed("id", "k"), str(tmp_path / "t"), "k")
    assert spark.read.parquet(str(tmp_path / "t")).count() == 8
    (tmp_path / "f.bin").write_bytes(b"abc")
    assert S.digests(spark, str(tmp_path / "f.bin")).first()[1:] == (3, hashlib.sha256(b"abc").hexdigest())


def test_affordances(spark, tmp_path):
    record = {"id": "p", "affordance": {"task": ["Sort  Things"], "domain": "CS", "findings": ["f" * 90], "contributions": [{"name": "M", "achieves": ["speed"], "overcomes": [], "builds_on": ["N"]}]}}
    (tmp_path / "a.jsonl").write_text(json.dumps(record))
    got = {tuple(r) for r in S.affordance_edges(S.read_jsonl(spark, str(tmp_path / "a.jsonl"), S.AFFORDANCES)).collect()}
    assert got == {("p", "addresses", "[task] sort things"), ("p", "in_field", "[domain] cs"), ("p", "reports", "[finding] " + "f" * 70), ("p", "contributes", "[method] m"), ("[method] m", "achieves", "[function] speed"), ("[method] m", "builds_on", "[method] n")}


def test_resolution(spark):
    titles = spark.createDataFrame([("a deep model of rivers", "a deep model of rivers"), ("graph walks", "graph walk"), ("one two three four five six", "one two three four five seven")], "a string, b string")
    scores = [r[0] for r in titles.select(R.title_similarity(F.col("a"), F.col("b"))).collect()]
    assert scores[0] == 1.0 and scores[1] > 0.9 and 0.7 < scores[2] < 0.95
    fields = spark.createDataFrame([(["x", "y"], ["y", "x"], "x", "y", True), (["x"], ["z"], "x", "z", False), (["x"], ["z"], "x", "z", None)], "a array<string>, b array<string>, p string, q string, d boolean")
    e = R.label_evidence(F.col("a"), F.col("b"), F.col("p"), F.col("q"))
    names = ("disjoint", "overlap2", "primary", "domain_jump")
    rows = fields.select(*(R.policy(n, e["n_shared"], e["primary_equal"], F.col("d")) for n in names), R.band(e["labelled"], e["n_shared"], e["primary_equal"])).collect()
    assert [tuple(r) for r in rows] == [("same", "same", "cross", "same", "overlap_2plus"), ("cross", "cross", "cross", "cross", "disjoint"), ("cross", "cross", "cross", "cross", "disjoint")]
    v = spark.createDataFrame([(1, "same"), (1, "cross"), (2, "same"), (3, None), (3, "same")], "query_id int, verdict string")
    assert {r.query_id: r.slice for r in R.query_slice(v).collect()} == {1: "cross_involved", 2: "same_only", 3: "unlabelled"}
    w = spark.createDataFrame([(1, "t", ["a"]), (2, "t", ["b"]), (3, "t", ["a", "c"]), (4, "u", ["a"]), (5, "v", []), (6, "v", ["z"])], "id long, title string, authors array<string>")
    assert {r.id: r.work for r in R.same_works(w).collect()} == {1: 1, 2: 2, 3: 1, 4: 4, 5: 5, 6: 5}
