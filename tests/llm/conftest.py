"""Fixtures of the corpus operators: the smallest tables, and rows with every awkward value."""

import pandas as pd
import pytest

SMALL = "/root/testdata/sf0.001"

#: Rows that every operator must take: nulls, blanks, ties, repeated rows, one id with two texts, a very long text.
AWKWARD = [
    (1, "alpha beta gamma", "a"),
    (1, "alpha beta gamma", "a"),
    (2, None, "a"),
    (3, "", None),
    (4, " \t\n\x0b ", None),
    (None, "alpha beta gamma", "b"),
    (None, None, "b"),
    (5, "ALPHA beta\ngamma", "b"),
    (6, "one text of an id that has two", "b"),
    (6, "another text of an id that has two", "b"),
    (7, "naïve ünïcode 字 \U0001f600 " * 30, ""),
    (8, "word " * 120_000, "c"),
]
AWKWARD_SCHEMA = "doc_id long, text string, source string"
#: Names that operators use for columns of their own.
CLASHING = ["size", "print", "rank", "part", "fp", "key", "component", "n", "label", "start", "item_id", "score", "_text", "_score", "spans", "copies", "gone", "holder", "place", "r", "found"]


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="session")
def small_rows():
    return pd.read_parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="session")
def awkward(spark):
    """The awkward rows, with extra columns whose names operators use."""
    from pyspark.sql import functions as F

    rows = spark.createDataFrame(AWKWARD, AWKWARD_SCHEMA)
    return rows.withColumns({c: F.lit("extra") for c in CLASHING})


@pytest.fixture(scope="session")
def nothing(awkward):
    return awkward.limit(0)
