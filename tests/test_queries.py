"""Every registered query against its SQL twin on DuckDB."""

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check import TABLES, rows

QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def database(sf):
    connection = duckdb.connect()
    for name in TABLES:
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, sf, database, name):
    mine = QUERIES[name](spark, sf).toPandas()
    if name not in SQL:
        assert len(mine) > 0
        return
    theirs = database.sql(SQL[name]).df()
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert rows(mine) == rows(theirs)


def test_entry_and_names(spark):
    assert entry.entry(spark).count() == 11
    assert set(SQL) <= set(QUERIES)
