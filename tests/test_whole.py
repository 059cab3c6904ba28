"""Queries that leave no row out, against brute force on small tables."""

import math

import pytest

from quillspan.plans import load

QUERIES = load().QUERIES


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    put = lambda name, rows, ddl: spark.createDataFrame(rows, ddl).write.parquet(f"{path}/{name}.parquet")
    put("customer", [(1, 0, "A"), (2, 1, "B"), (10, 0, "A"), (11, 1, "A")], "c_custkey int, c_nationkey int, c_mktsegment string")
    put("orders", [(7, 1), (8, 2), (9, 11)], "o_orderkey int, o_custkey int")
    put("lineitem", [(7, p, 1 + p % 2, 1.0 + p) for p in range(8)] + [(8, 3, 2, 50.0), (9, 0, 1, 2.0)], "l_orderkey int, l_partkey int, l_suppkey int, l_quantity double")
    put("supplier", [(1, 0), (2, 1)], "s_suppkey int, s_nationkey int")
    put("nation", [(0, 0), (1, 0)], "n_nationkey int, n_regionkey int")
    put("benchmark", [(1, "red green blue"), (2, "red green grey"), (22, "no such"), (23, "blue red green"), (24, None)], "item_id int, text string")
    return path


@pytest.fixture(scope="module")
def graph(spark, folder):
    rows = lambda t: spark.read.parquet(f"{folder}/{t}.parquet").collect()
    e = {(f"[customer] {r.o_custkey}", f"[order] {r.o_orderkey}") for r in rows("orders")}
    e |= {(f"[order] {r.l_orderkey}", f"[part] {r.l_partkey}") for r in rows("lineitem")} | {(f"[part] {r.l_partkey}", f"[supplier] {r.l_suppkey}") for r in rows("lineitem")}
    e |= {(f"[customer] {r.c_custkey}", f"[nation] {r.c_nationkey}") for r in rows("customer")} | {(f"[supplier] {r.s_suppkey}", f"[nation] {r.s_nationkey}") for r in rows("supplier")}
    e |= {(f"[nation] {r.n_nationkey}", f"[region] {r.n_regionkey}") for r in rows("nation")}
    near = {}
    for a, b in e:
        near.setdefault(a, []).append(b)
        near.setdefault(b, []).append(a)
    return near, {0: ["[customer] 1", "[customer] 10", "[customer] 11"], 1: ["[customer] 2"]}


@pytest.mark.parametrize("name, rounds, restart", [("e15_random_walk", 3, 0.15), ("e16_personalised_rank", 50, 0.05)])
def test_walks(spark, folder, graph, name, rounds, restart):
    near, seeds = graph
    want = {}
    for q, nodes in seeds.items():
        x = start = {n: 1 / len(nodes) for n in nodes}
        for _ in range(rounds):
            y = {n: restart * m for n, m in start.items()}
            for n, m in x.items():
                for other in near[n]:
                    y[other] = y.get(other, 0.0) + (1 - restart) * m / len(near[n])
            x = y
        want |= {(q, n): m for n, m in x.items()}
    got = {(r.query_id, r.node): r.mass for r in QUERIES[name](spark, folder).collect()}
    assert got.keys() == want.keys() and any("[order]" in n for _, n in got)
    assert all(math.isclose(got[k], m, abs_tol=1e-7) for k, m in want.items())


def test_hops(spark, folder, graph):
    near, seeds = graph
    want = {}
    for q, nodes in seeds.items():
        front = set(nodes)
        for i in range(4):
            want |= {(q, n): i for n in front}
            front = {o for n in front for o in near[n]} - {n for p, n in want if p == q}
    assert {(r.query_id, r.node): r.hops for r in QUERIES["e18_hops"](spark, folder).collect()} == want
    kinds = {}
    for (q, n), i in want.items():
        kinds[q, n[1 : n.index("]")], i] = kinds.get((q, n[1 : n.index("]")], i), 0) + 1
    assert {(r.query_id, r.kind, r.hops): r.n for r in QUERIES["e20_reach_by_type"](spark, folder).collect()} == kinds


def test_layers_and_weights(spark, folder, graph):
    near, seeds = graph
    got = {(r.query_id, r.node): r.value for r in QUERIES["e24_sum_product"](spark, folder).collect()}
    assert got[0, "[order] 7"] == 1.0 and got[0, "[nation] 0"] == 1.0 and got[1, "[order] 8"] == 1.0 and (0, "[order] 8") not in got
    deep = {(r.query_id, r.node): r.value for r in QUERIES["e25_bellman_ford"](spark, folder).collect()}
    assert deep[1, "[part] 3"] == 2.7 and math.isclose(deep[1, "[supplier] 2"], 0.675)
    met = {(r.query_id, r.node): r.mean for r in QUERIES["d20_moments"](spark, folder).collect()}
    assert met[0, "[order] 9"] == 1.0 and met[1, "[order] 8"] == 2.0
    weights = {(r.query_id, r.node): r.weight for r in QUERIES["e29_seed_weights"](spark, folder).collect()}
    total = sum(len(near[n]) ** -0.5 for n in seeds[0])
    assert weights == {(q, n): round(len(near[n]) ** -0.5 / total, 6) if q == 0 else 1.0 for q, x in seeds.items() for n in x}
    hit = {(r.query_id, r.node) for r in QUERIES["e22_hitting"](spark, folder).collect()}
    assert {(0, "[order] 7"), (1, "[order] 8"), (0, "[supplier] 1")} <= hit


def test_jaccard(spark, folder):
    got = {(r.a, r.b): r.jaccard for r in QUERIES["b44_jaccard"](spark, folder).collect()}
    assert got == {(1, 2): 0.5, (1, 23): 1.0, (2, 23): 0.5}


def test_linked_entities(spark, folder):
    got = sorted(tuple(r) for r in QUERIES["c21_linked_entities"](spark, folder).select("o_custkey", "l_partkey").collect())
    assert got == [(1, p) for p in range(8)] + [(2, 3), (11, 0)]
