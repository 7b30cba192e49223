"""Every registered query against its SQL in DuckDB, on whole tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from tidemark.workload.fixtures import SQL, TABLES, duck_sql, fixture
from tools.check_queries import rows_of

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_derived_table(spark, sf, duck, name):
    result = duck.execute(duck_sql(name))
    columns = [c[0] for c in result.description]
    df = fixture(spark, sf, name)
    assert df.columns == columns
    assert rows_of(df.columns, df.collect()) == rows_of(columns, result.fetchall())


@pytest.mark.parametrize("name", [n for n in QUERIES if n in ORACLES])
def test_query(spark, sf, duck, name):
    result = duck.execute(ORACLES[name])
    columns = [c[0] for c in result.description]
    df = QUERIES[name](spark, sf)
    assert sorted(df.columns) == sorted(columns)
    assert rows_of(df.columns, df.collect()) == rows_of(columns, result.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
