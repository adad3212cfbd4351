"""Every query with SQL gives what DuckDB gives over the smallest tables; the others run."""

import math
from collections import Counter
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry_points
from tallyloom.plans import checks, oracles, queries

SMALL = "/root/testdata/sf0.001"
QUERIES, ORACLES = queries.QUERIES | checks.QUERIES, oracles.ORACLES | checks.ORACLES


@pytest.fixture(scope="module")
def con():
    found = duckdb.connect()
    found.sql("SET TimeZone = 'UTC'")
    for path in Path(SMALL).glob("*.parquet"):
        found.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return found


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 5) + 0.0
    return value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_plain(row[i]) for i in order) for row in rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_and_sql_agree(spark, con, name):
    found = QUERIES[name](spark, SMALL)
    expected = con.sql(ORACLES[name])
    assert sorted(found.columns) == sorted(expected.columns)
    assert _rows(found.columns, found.collect()) == _rows(expected.columns, expected.fetchall())


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - ORACLES.keys()))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, SMALL).count() > 0


def test_entry_points(spark):
    assert entry_points.entry(spark).count() > 0
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())
    assert set(QUERIES) <= set(entry_points.queries())
