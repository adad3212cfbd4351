"""Joins of uneven keys give what plain joins give, whatever counts as heavy."""

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import skew


@pytest.mark.parametrize("least", [1, 10, 1000])
def test_uneven_joins_are_joins(spark, monkeypatch, least):
    monkeypatch.setattr(skew, "HEAVY_ROWS", least)
    monkeypatch.setattr(skew, "HEAVY_SHARE", 50)
    rows = spark.range(2000).select("id", F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 100 == 1, None).otherwise(F.col("id") % 500).alias("k"))
    table = rows.where("k != 13").groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("last"))
    expected = sorted(map(tuple, rows.join(table.drop("n"), "k").select("id", "k", "last").collect()))
    assert len(expected) > 1000
    for found in (skew.join_uneven(rows, table, "k", "n", 2000), skew.join_salted(rows, table.drop("n"), "k", F.col("id"), 2000)):
        assert sorted(map(tuple, found.select("id", "k", "last").collect())) == expected


def test_few_keys_are_heavy():
    for total in (0, 10**3, 10**6, 10**12):
        assert total / skew.heavy_rows(total) <= skew.HEAVY_SHARE
