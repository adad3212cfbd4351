"""Preparation of rows for encoding, against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import generate, prepare


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(2)
    made = [(i, rng.choice([3, 5, 9, 12]), rng.choice(["binary", "choice", None])) for i in range(100)] + [(100, None, "binary")]
    return made, spark.createDataFrame(made, "id long, size int, kind string")


def test_types_and_first_rows(rows):
    made, df = rows
    assert sorted(r.id for r in prepare.of_types(df, ["binary"], "kind").collect()) == [i for i, _, k in made if k == "binary"]
    assert [r.id for r in prepare.first_rows(df, 3, ["id"]).collect()] == [0, 1, 2]
    assert prepare.first_rows(df, None, ["id"]) is df
    with pytest.raises(ValueError):
        prepare.first_rows(df, 0, ["id"])


def test_no_row_is_cut_or_lost_by_its_length(rows):
    made, df = rows
    kept, long = prepare.split_by_length(df, F.col("size"), 9)
    assert {r.id for r in long.collect()} == {i for i, s, _ in made if (s or 0) > 9}
    assert kept.count() + long.count() == len(made)
    assert prepare.split_by_length(df, F.col("size"), None)[1].count() == 0
    assert prepare.require_length(df, F.col("size"), 12).count() == len(made)
    with pytest.raises(Exception, match="at most 9"):
        prepare.require_length(df, F.col("size"), 9).collect()


def test_longest_first(rows):
    made, df = rows
    order = sorted(made, key=lambda r: (-(r[1] or 0), r[0]))
    expected = {r[0]: (k // 8, k % 8) for k, r in enumerate(order)}
    assert {r.id: (r.batch, r.place) for r in prepare.longest_first(df, F.col("size"), "id", 8).collect()} == expected


def test_fingerprints_and_stamps(spark):
    assert prepare.fingerprint({"a": 1, "b": [2]}) == prepare.fingerprint({"b": [2], "a": 1}) != prepare.fingerprint({"a": 1, "b": [3]})
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("UTC", "Asia/Tokyo"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            made = spark.range(1).select(prepare.utc_stamp(F.timestamp_micros(F.lit(1_700_000_000_900_000))).alias("s")).first().s
            assert made == "2023-11-14T22:13:20+00:00"
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_other_rubrics_of_impact_fail(spark):
    df = spark.createDataFrame([(1, 2, 6)], "x int, y int, m int")
    with pytest.raises(Exception, match="3, 4 or 5"):
        df.select(generate.impact_level(F.col("x"), F.col("y"), F.col("m"))).collect()
