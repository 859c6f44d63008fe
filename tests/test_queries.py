"""Every query against DuckDB on the smallest tables."""

import duckdb
import pytest

from brightwell.plans.registry import ORACLE_SQL, QUERIES

TABLES = ("events", "embeddings", "orders", "lineitem")


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return c


def plain(df):
    df = df[sorted(df.columns)].astype(object)
    rows = df.where(df.notna(), None).itertuples(index=False)
    return list(df.columns), sorted([tuple("" if v is None else f"{float(v):.5f}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v) for v in r) for r in rows])


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, sf, duck, name):
    assert plain(QUERIES[name](spark, sf).toPandas()) == plain(duck.execute(ORACLE_SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry_points_agree():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
