"""Every query with comparison SQL gives the same rows as DuckDB."""

import duckdb
import pytest

import __spark_entry__ as entry
from tools.compare import TABLES, canonical

ORACLE = entry.oracle_sql()
QUERIES = entry.queries()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches(name, spark, sf, duck):
    got = canonical(QUERIES[name](spark, sf).toPandas())
    want = canonical(duck.execute(ORACLE[name]).df())
    assert list(got.columns) == list(want.columns)
    assert len(got) == len(want)
    for c in got.columns:
        assert got[c].map(str).tolist() == want[c].map(str).tolist(), c


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(name, spark, sf):
    df = QUERIES[name](spark, sf)
    assert df.columns and len(df.take(5)) > 0


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert rows and all(r["regime"] in range(6) and 0 <= r["risk_score"] <= 10 for r in rows)
