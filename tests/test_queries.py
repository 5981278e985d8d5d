"""Every registered query with SQL gives on sf0.001 what DuckDB gives."""

import os

import duckdb
import pytest

from maskwell import queries as Q



@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in os.listdir(sf):
        con.execute(f"create view {t.removesuffix('.parquet')} as select * from '{sf}/{t}'")
    return con


def rows(df):
    columns = sorted(df.columns)
    return columns, sorted(tuple(str(round(x, 6)) if isinstance(x, float) else str(x) for x in r) for r in df[columns].itertuples(index=False))


@pytest.mark.parametrize("name", Q.SQL)
def test_query_matches_sql(spark, sf, duck, name):
    assert rows(Q.QUERIES[name](spark, sf).toPandas()) == rows(duck.execute(Q.SQL[name]).df())


@pytest.mark.parametrize("name", sorted(Q.ROWS_ONLY))
def test_rows_only(spark, sf, name):
    assert Q.QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
