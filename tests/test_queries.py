"""Every query with SQL gives the rows that DuckDB gives, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from quillspan.plans import load
from tests.conftest import SMALL

REGISTRY = load()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SMALL}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def canon(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def cell(v):
        return "" if v is None else f"{round(v, 5) + 0.0:.5f}" if isinstance(v, float) else str(list(v)) if isinstance(v, (list, tuple)) else str(v)

    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(REGISTRY.SQL))
def test_matches_sql(spark, duck, name):
    got = REGISTRY.QUERIES[name](spark, SMALL)
    want = duck.sql(REGISTRY.SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert canon([tuple(r) for r in got.collect()], got.columns) == canon(want.fetchall(), want.columns)


@pytest.mark.parametrize("name", sorted(set(REGISTRY.QUERIES) - set(REGISTRY.SQL)))
def test_runs(spark, name):
    assert REGISTRY.QUERIES[name](spark, SMALL).count() > 0


def test_stream_equals_batch(spark):
    stream, batch = (REGISTRY.QUERIES[n](spark, SMALL).orderBy("day", "event_type").collect() for n in ("s03_stream_equals_batch", "s01_tumbling_windows"))
    assert stream == batch
