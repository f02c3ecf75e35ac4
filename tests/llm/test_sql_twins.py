"""Queries with an SQL twin, compared on DuckDB."""

import duckdb
import pytest

from tabulon.llm import oracles, queries
from tools.check import TABLES, rows


@pytest.mark.parametrize("name", list(oracles.statements()))
@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_twins(spark, name, size):
    base = f"/root/testdata/{size}"
    connection = duckdb.connect()
    for t in TABLES:
        connection.sql(f"CREATE VIEW {t} AS SELECT * FROM '{base}/{t}.parquet'")
    mine = queries.registry()[name](spark, base).toPandas()
    theirs = connection.sql(oracles.statements()[name]).df()
    assert sorted(mine.columns) == sorted(theirs.columns) and len(mine)
    assert rows(mine) == rows(theirs)


def test_mined_rules_in_sql(spark, monkeypatch):
    """With thresholds that some rules reach, both sides find the same ones."""
    from tabulon.llm import url_rules

    base = "/root/testdata/sf0.01"
    for module in (oracles, url_rules):
        monkeypatch.setattr(module, "LEAST_ROWS", 4)
        monkeypatch.setattr(module, "LEAST_CONFIDENCE", 0.3)
    connection = duckdb.connect()
    for t in TABLES:
        connection.sql(f"CREATE VIEW {t} AS SELECT * FROM '{base}/{t}.parquet'")
    pages, labels = (spark.read.parquet(f"{base}/{t}.parquet") for t in ("pages", "labels"))
    labelled = url_rules.labelled_urls(pages, labels)
    mine = url_rules.judged(pages, labelled, confidence=0.3, least_rows=4).toPandas()
    theirs = connection.sql(oracles._url_rules()).df()
    assert mine["mined"].sum() > 0 and rows(mine) == rows(theirs)
