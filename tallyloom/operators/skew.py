"""Joins by keys of which some may hold a large part of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key is heavy if it holds more than this many rows, and more than one in HEAVY_SHARE of all rows, so that there are
#: fewer than HEAVY_SHARE heavy keys at any size.
HEAVY_ROWS, HEAVY_SHARE = 200, 50_000


def heavy_rows(total: int) -> int:
    """The number of rows above which a key is heavy among ``total`` rows."""
    return max(HEAVY_ROWS, total // HEAVY_SHARE)


def join_uneven(rows: DataFrame, table: DataFrame, key: str, held: str, total: int) -> DataFrame:
    """``rows`` inner-joined by ``key`` to ``table``, which has one row per key and in ``held`` the rows of that key.

    Heavy keys are fewer than ``HEAVY_SHARE``, whatever the size: their rows of ``table`` are broadcast, so that the
    rows that hold them stay where they are. All other keys are joined by a shuffle in which none stands out. The
    result has the columns of ``rows`` and those of ``table`` but ``held``; a null key joins nothing.
    """
    least = heavy_rows(total)
    heavy, light = table.where(F.col(held) > least).drop(held), table.where(F.col(held) <= least).drop(held)
    few = F.broadcast(heavy)
    return rows.join(few, key).unionByName(rows.join(few.select(key), key, "left_anti").join(light, key))


def join_salted(rows: DataFrame, table: DataFrame, key: str, spread: Column, total: int, counted: DataFrame | None = None) -> DataFrame:
    """As ``join_uneven`` for a ``table`` whose rows are too large to be broadcast.

    A heavy key's rows are dealt by the whole number ``spread`` into as many parts as it has times the rows that make a
    key heavy, and its row of ``table`` goes to each. Only heavy keys and their parts are broadcast. ``counted`` has the same keys as
    ``rows`` and is counted in their place, if they take work to make.
    """
    least = heavy_rows(total)
    held = (rows if counted is None else counted).groupBy(key).agg(F.count("*").alias("_held")).where(F.col("_held") > least)
    few = F.broadcast(held.select(key, F.ceil(F.col("_held") / least).cast("int").alias("_parts")))
    parts = F.coalesce("_parts", F.lit(1))
    dealt = rows.join(few, key, "left").withColumn("_part", F.pmod(spread, parts).cast("int")).drop("_parts")
    copied = table.join(few, key, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    return dealt.join(copied, [key, "_part"]).drop("_part")
