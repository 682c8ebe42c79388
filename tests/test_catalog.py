"""Every query with SQL agrees with DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from graphloom import catalog


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in os.listdir(sf_dir):
        c.sql(f"CREATE VIEW {t.split('.')[0]} AS FROM read_parquet('{sf_dir}/{t}')")
    return c


def plain(frame):
    def cell(v):
        if v is None or v != v:
            return "NULL"
        return f"{float(v):.9g}" if isinstance(v, (int, float)) or getattr(getattr(v, "dtype", None), "kind", "") in tuple("if") else str(v)

    columns = sorted(frame.columns)
    return columns, sorted(tuple(map(cell, r)) for r in frame[columns].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_matches_sql(spark, sf_dir, con, name):
    assert plain(catalog.queries()[name](spark, sf_dir).toPandas()) == plain(con.sql(catalog.oracle_sql()[name]).df())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 10
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
