"""Small cases worked out by hand, and properties."""

import math

import numpy as np
import pytest

from quillspan.functions import text as T
from quillspan.operators import graph as G
from quillspan.operators.dense import largest
from quillspan.operators import evaluation as E
from quillspan.operators import metrics as M
from quillspan.operators import ranking as R
from quillspan.operators.components import connected_components
from quillspan.operators.sampling import carve, first_by_hash
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def run(spark):
    return spark.createDataFrame([(1, "d3", 1, 0.9), (1, "d1", 2, 0.8), (1, "d9", 3, 0.5), (1, "d2", 4, 0.1)], "query_id int, doc_id string, rank int, score double")


def test_metrics_by_hand(spark, run):
    qrels = spark.createDataFrame([(1, "d1"), (1, "d2"), (2, "d1")], "query_id int, doc_id string")
    rows = {r.query_id: r for r in M.per_query(run, qrels).collect()}
    assert (rows[1].mrr, rows[1].mgrr, rows[1].map, rows[1].recall_2) == (0.5, 0.375, 0.5, 0.5)
    assert rows[2].mrr == rows[2].map == rows[2].ndcg_10 == 0
    assert math.isclose(rows[1].ndcg_5, (1 / math.log2(3) + 1 / math.log2(5)) / (1 + 1 / math.log2(3)))


def test_complete_sets(spark, run):
    sets = spark.createDataFrame([(1, 0, "d1"), (1, 0, "d2"), (1, 1, "d1"), (1, 1, "d7")], "query_id int, set_id int, doc_id string")
    r = M.complete_sets(run, sets, (2, 5)).first()
    assert (r.complete_2, r.complete_5) == (0.0, 1.0)


def test_zscores(spark):
    s = spark.createDataFrame([(1, 1, 1.0), (1, 2, 2.0), (1, 3, 3.0)], "query_id int, doc_id int, score double")
    assert math.isclose(max(r.score for r in R.zscore(s).collect()), 1 / (1 + 1e-6))
    assert math.isclose(max(r.score for r in R.zscore(s, sample=False).collect()), 1 / (math.sqrt(2 / 3) + 1e-6))


def test_medians(spark):
    df = spark.createDataFrame([(x,) for x in (1.0, 2.0, 3.0, 10.0)], "v double")
    assert (E.nth_value(df, [], "v", 0.5).first().v, df.agg(F.median("v")).first()[0]) == (3.0, 2.5)


def test_path_graph(spark):
    edges = spark.createDataFrame([("a", "r", "b"), ("b", "r", "c"), ("c", "r", "doc")], "src string, rel string, dst string")
    seeds = spark.createDataFrame([(1, "a")], "query_id int, node string")
    assert {r.node: r.hops for r in G.hops(edges, seeds, 3).collect()}["doc"] == 3
    assert math.isclose(sum(r.mass for r in G.random_walk(edges, seeds).collect()), 1.0)


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101), (101, 101), (None, 3), (7, 8)], "a long, b long")
    got = {r.node: r.component for r in connected_components(edges).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {100: 100, 101: 100}
    assert connected_components(edges.limit(0)).count() == 0


def test_ratings(spark):
    games = spark.createDataFrame([("x", "y", 7.5, 10)], "a string, b string, points_a double, n int")
    got = dict(M.bradley_terry(games))
    assert math.isclose(got["x"] - got["y"], 400 * math.log10(3), rel_tol=1e-6) and math.isclose(got["x"] + got["y"], 2000)


def test_text_functions(spark):
    df = spark.createDataFrame([("Éa-b  C <i>x</i> &amp; z.", "https://doi.org/10.1/AB.", "[task] do it")], "t string, doi string, node string")
    r = df.select(T.fold("t"), T.fold_markup(F.col("t")), T.norm_doi(F.col("doi")), T.node_type(F.col("node")), T.strip_type(F.col("node")), T.untag(F.col("t"))).first()
    assert r[:] == ("ea b c i x i amp z", "ea b c x z", "10.1/ab", "task", "do it", "Éa-b C x & z.")


def test_samples_nest(spark):
    df = spark.range(200).withColumnRenamed("id", "k")
    small, large = ({r.k for r in first_by_hash(df, "k", n).collect()} for n in (20, 60))
    assert small < large and len(large) == 60


def test_carve_keeps_golds(spark):
    q = spark.range(10).select(F.col("id").alias("query_id"))
    corpus = spark.range(100).select(F.col("id").alias("doc_id"))
    qrels = q.select("query_id", (F.col("query_id") * 7).alias("doc_id"))
    q2, r2, c2 = carve(q, qrels, corpus, 3, 20)
    assert (q2.count(), r2.count(), c2.count()) == (3, 3, 20)


def test_nth_value_by_slices(spark, monkeypatch):
    """The nth of few and many equal values, null groups and NaN, without all values in one window."""
    import math
    import random

    from quillspan.operators import evaluation as E

    draw = random.Random(3)
    rows = [(k, draw.choice([1.5, 1.5, -2.0, float("nan"), None, draw.random()])) for k in [1] * 300 + [2] * 7 + [None] * 40 for _ in range(2)]
    df = spark.createDataFrame(rows, "k int, v double")
    for share in (0.0, 0.5, 0.975):
        want = {}
        for k in (1, 2, None):
            line = sorted((v for x, v in rows if x == k and v is not None), key=lambda v: (math.isnan(v), v))
            want[k] = str(line[int(len(line) * share)])
        got = E.nth_value(df, ["k"], "v", share)
        assert {r.k: str(r.v) for r in got.collect()} == want and got.count() == 3
    # 2,000 values in one group: no task orders them all.
    many = E.nth_value(spark.range(2000).selectExpr("cast(id as double) v"), [], "v", 0.5)
    assert many.first().v == 1000.0 and "slice" in many._jdf.queryExecution().toString()
    assert E.nth_value(df.limit(0), ["k"], "v", 0.5).count() == 0


def test_places_of_asked_elements():
    import numpy as np

    from quillspan.operators.views import places_of

    draw = np.random.default_rng(5)
    for x in (draw.random(200), draw.integers(0, 5, 200).astype(float), np.zeros(9), np.where(draw.random(50) < 0.3, np.nan, draw.integers(0, 3, 50))):
        place = np.empty(len(x), dtype=np.int32)
        place[np.argsort(-x, kind="stable")] = np.arange(1, len(x) + 1)
        asked = np.flatnonzero(draw.random(len(x)) < 0.5)
        assert (places_of(x, asked) == place[asked]).all()


@pytest.mark.parametrize("long", (1, 3, 1000))
def test_shortcuts_by_lists(spark, long):
    """Repeats, loops, sources with many steps and nodes that reach much; pairs of ends are shuffled for such sources alone."""
    rows = [(f"s{i % 9}", "a", f"x{i * 7 % 11}") for i in range(60)] + [(f"x{i % 11}", "b", f"d{i * 5 % 23}") for i in range(120) if i % 11 > 2]
    rows += [("x9", "b", "s1"), ("x0", "b", "d0"), ("one", "a", "x0"), ("one", "c", "x9"), ("x0", "d", "one"), ("one", "c", "x0")]
    edges, pairs = spark.createDataFrame(rows + rows[::3], "src string, rel string, dst string"), [("a", "b"), ("c", "d"), ("c", "b")]
    want = {(s, f"short_{q}", o) for s, r, x in rows for y, q, o in rows if x == y and (r, q) in pairs and s != o}
    got = [tuple(r) for r in G.shortcuts(edges, pairs, long=long).collect()]
    assert len(got) == len(want) and set(got) == want


def test_numbers_without_gaps(spark):
    numbers, n = G.numbered(spark.createDataFrame([(f"n{i % 40}",) for i in range(100)], "node string").repartition(5), "numbers")
    assert n == 40 and sorted(r.number for r in numbers.collect()) == list(range(40)) and numbers.select("node").distinct().count() == 40


@pytest.mark.parametrize("single", (True, False))
def test_walk_by_blocks(spark, single):
    """Many blocks, a pass for each query, loops, parallel edges, a null end, seeds beside the graph; no table of masses is left."""
    rows = [(f"n{i * 3 % 17}", f"n{i * 7 % 23}") for i in range(60)] + [("a", "a"), ("a", "n0"), ("n0", "a"), ("n1", None)]
    seeds = [("p", "a"), ("p", "n1"), ("p", "a"), ("q", "n2"), ("r", "alone")]
    ends = [e for e in rows if not single or e[0] != e[1]]
    steps = [s for a, b in ends for s in ((a, b), (b, a)) if not single or None not in s]
    steps = list(set(steps)) if single else steps
    want = {}
    for q in "pqr":
        own = {n for p, n in seeds if p == q}
        x = start = {n: 1 / len(own) for n in own}
        for _ in range(4):
            y = {n: 0.1 * m for n, m in start.items()}
            for a, b in steps:
                if a is not None and a in x:
                    y[b] = y.get(b, 0.0) + 0.9 * x[a] / sum(s == a for s, _ in steps)
            x = y
        want |= {(q, n): m for n, m in x.items()}
    edges, asked = spark.createDataFrame(rows, "src string, dst string"), spark.createDataFrame(seeds, "query_id string, node string")
    for size, most in ((8, 1), (1000, 1 << 30)):
        before = {t.name for t in spark.catalog.listTables()}
        got = {(r.query_id, r.node): r.mass for r in G.walk(edges, asked, 4, 0.1, single=single, size=size, most=most).collect()}
        assert {t.name for t in spark.catalog.listTables()} == before
        assert got.keys() == want.keys() and all(math.isclose(got[k], m) for k, m in want.items())


@pytest.mark.parametrize("n, k, least", ((300, 8, None), (5, 8, None), (2048, 8, 0.1), (700, 100, None), (1, 1, None), (40, 3, 0.2)))
def test_largest_of_rows(n, k, least):
    """Ties stay, as with all scores rounded and ordered."""
    rng = np.random.default_rng(1)
    scores = rng.normal(size=(50, n)) if n == 2048 else rng.integers(-9, 9, (50, n)) / 10.0 + rng.normal(size=(50, n)) * 1e-15
    scores[3], scores[4, :-1] = -np.inf, -np.inf
    want = np.round(scores, 12)
    kept = want > -np.inf if least is None else want >= least
    if n > k:
        kept &= want >= -np.partition(-want, k - 1, axis=1)[:, k - 1 : k]
    rows, columns, found = largest(scores, k, least)
    assert [*zip(rows, columns)] == [*zip(*np.nonzero(kept))] and (found == want[kept]).all()


@pytest.mark.parametrize("single", (True, False))
def test_walk_whole(spark, single):
    """A graph that a task holds is walked without a job for each round, to the masses of blocks of nodes."""
    rows = [(f"n{i * 3 % 17}", f"n{i * 7 % 23}") for i in range(60)] + [("a", "a"), ("a", "n0"), ("n0", "a"), ("n1", None), (None, None)]
    seeds = [("p", "a"), ("p", "n1"), ("p", "a"), ("q", "n2"), ("r", "alone"), ("s", None), (None, "a")]
    edges, asked = spark.createDataFrame(rows, "src string, dst string"), spark.createDataFrame(seeds, "query_id string, node string")
    status, masses, jobs = spark.sparkContext.statusTracker(), [], []
    for whole, rounds in ((0, 3), (G.WHOLE, 3), (G.WHOLE, 40)):
        spark.sparkContext.setJobGroup(f"walk-{single}-{whole}-{rounds}", "")
        masses.append({(r.query_id, r.node): r.mass for r in G.walk(edges, asked, rounds, 0.1, single=single, size=8, most=1, whole=whole).collect()})
        jobs.append(len(status.getJobIdsForGroup(f"walk-{single}-{whole}-{rounds}")))
    assert masses[0].keys() == masses[1].keys() and ("s", None) in masses[1] and all(math.isclose(masses[1][k], m) for k, m in masses[0].items())
    assert jobs[1] == jobs[2]


def test_walk_over_tiles(spark, monkeypatch):
    """Nodes of several tiles, and more queries than tasks."""
    monkeypatch.setattr(G, "TILE", 8)
    rows = [(i * i % 61, i * 7 % 53) for i in range(200)]
    seeds = [(q, q * 5 % 61) for q in range(11)] + [(q, q * 3 % 53) for q in range(11)]
    edges, asked = spark.createDataFrame(rows, "src int, dst int"), spark.createDataFrame(seeds, "query_id int, node int")
    near = {}
    for a, b in {(a, b) for a, b in rows if a != b} | {(b, a) for a, b in rows if a != b}:
        near.setdefault(a, []).append(b)
    want = {}
    for q in range(11):
        own = {n for p, n in seeds if p == q}
        x = start = {n: 1 / len(own) for n in own}
        for _ in range(6):
            y = {n: 0.05 * m for n, m in start.items()}
            for a, m in x.items():
                for b in near.get(a, ()):
                    y[b] = y.get(b, 0.0) + 0.95 * m / len(near[a])
            x = y
        want |= {(q, n): m for n, m in x.items()}
    got = {(r.query_id, r.node): r.mass for r in G.walk(edges, asked, 6, 0.05, single=True).collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[k], m) for k, m in want.items())
