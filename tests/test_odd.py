"""Queries against their SQL on odd rows."""

import duckdb
import pytest

from quillspan.plans import load
from tests.test_queries import canon

REGISTRY = load()


@pytest.fixture
def same(spark, tmp_path):
    """Compare a query with its SQL over tables that are made of rows."""

    def check(name, **tables):
        con = duckdb.connect()
        for table, (rows, ddl) in tables.items():
            spark.createDataFrame(rows, ddl).coalesce(1).write.parquet(f"{tmp_path}/{table}.parquet")
            con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
        got, want = REGISTRY.QUERIES[name](spark, str(tmp_path)), con.sql(REGISTRY.SQL[name])
        assert sorted(got.columns) == sorted(want.columns)
        assert canon([tuple(r) for r in got.collect()], got.columns) == canon(want.fetchall(), want.columns)

    return check


def test_articles_beside_other_alphabets(same):
    texts = ["éa ané the", "Añ the_ The.End", "a\u000bb\u0085the   an", "ΟΔΟΣ İa an", " \tthe\r\n", "", None]
    same("b25_normalize_answer", conversations=([(1, i, t) for i, t in enumerate(texts)], "conv_id long, turn long, text string"))


def test_supplier_keys_like_years(same):
    rows = [(k, f"Supplier#{k:09d}", k % 25) for k in (1, *range(1890, 2110), 20001)] + [(3000, "é1999 é", 1)]
    same("b29_reference_evidence", supplier=(rows, "s_suppkey long, s_name string, s_nationkey int"))


VIEWS = ("d15_background", "e38_multi_view", "e41_additive_fusion", "e42_mixture_fusion", "g10_merge_runs", "c18_rank_deltas", "f10_router_features", "h16_bootstrap", "j08_distillation", "j03_matchability", "j04_view_scales", "f09_view_scales", "c10_late_interaction", "h21_largest_moves", "h24_necessity", "j14_paired_ranks")
RUNS = ("g10_merge_runs", "c18_rank_deltas", "f10_router_features", "h16_bootstrap")


@pytest.fixture
def row_pairs(spark, monkeypatch):
    """Fail where pairs of vectors are multiplied row by row."""
    from quillspan.operators import graph, retrieval
    from quillspan.plans import fixtures, more_queries

    def dot(*_):
        raise AssertionError("a product of single rows")

    for module in (fixtures, graph, retrieval, more_queries):
        monkeypatch.setattr(module, "dot", dot, raising=False)
    return dot


def embeddings(nulls: bool):
    """Queries without later vectors of their label, equal vectors, labels that are null, vectors that are null."""
    v = lambda i: [((i * 37 + j * 11) % 19 - 9) / 10.0 for j in range(4)]
    rows = [(i, v(i % 60), None if i == 61 else i % 3) for i in range(1, 160)] + [(200, v(7), 9), (250, v(8), 2), (0, v(0), 0)]
    return rows + ([(170, None, 1), (171, None, 2)] if nulls else []), "vec_id long, embedding array<float>, label int"


@pytest.mark.parametrize("name", VIEWS)
def test_views_by_blocks(same, row_pairs, monkeypatch, name):
    monkeypatch.setattr("quillspan.functions.vectors.dot", row_pairs)
    same(name, embeddings=embeddings(name not in RUNS))


@pytest.mark.parametrize("name", ("e03_mutual_neighbours", "e03_soft_edges", "e02_consolidation", "e02_representatives"))
def test_neighbours_by_blocks(same, row_pairs, name):
    rows, ddl = embeddings(False)
    same(name, embeddings=([(i, [x + (i % 60) * j * 0.001 for j, x in enumerate(v)], 1 if k is None else k) for i, v, k in rows if i < 58], ddl))
