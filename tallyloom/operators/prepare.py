"""What stands between a dataset and its encoding: questions of some types, a first part, rows that are too long, their order."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def of_types(df: DataFrame, types: Sequence[str], kind: str | Column = "question.type") -> DataFrame:
    """Questions of the given types; a null type is none of them."""
    return df.where((F.col(kind) if isinstance(kind, str) else kind).isin(*types))


def first_rows(df: DataFrame, n: int | None, order: Sequence[str]) -> DataFrame:
    """The first ``n`` rows in ``order``, which must be total for reruns to agree; all of them for None."""
    if n is not None and n < 1:
        raise ValueError("at least one row is taken")
    return df if n is None else df.orderBy(*order).limit(n)


def split_by_length(df: DataFrame, length: Column, most: int | None) -> tuple[DataFrame, DataFrame]:
    """``df`` without its rows of more than ``most`` tokens, and those rows with ``_length``; nothing is ever cut short.

    A null length counts as 0. Without a bound no row is too long.
    """
    size = F.coalesce(length, F.lit(0))
    long = F.lit(False) if most is None else size > most
    return df.where(~long), df.withColumn("_length", size).where(long)


def require_length(df: DataFrame, length: Column, most: int) -> DataFrame:
    """``df``, failing the query at the first row of more than ``most`` tokens."""
    size = F.coalesce(length, F.lit(0))
    told = F.concat(F.lit("a row has "), size.cast("string"), F.lit(f" tokens; at most {most} are read"))
    return df.where(F.when(size > most, F.raise_error(told).cast("boolean")).otherwise(True))


def longest_first(df: DataFrame, length: Column, ident: str, batch: int) -> DataFrame:
    """``batch`` and ``place`` of every row in order of falling length, ties by ``ident``: batches of near-equal lengths.

    Rows are ranked within their length, and lengths, of which there are few, counted before.
    """
    from pyspark.sql import Window

    sized = df.withColumn("_size", F.coalesce(length, F.lit(0)))
    # Only the counts by length pass through one task: a row per distinct length.
    earlier = Window.orderBy(F.desc("_size")).rowsBetween(Window.unboundedPreceding, -1)
    before = sized.groupBy("_size").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    within = F.row_number().over(Window.partitionBy("_size").orderBy(ident)) - 1
    rank = F.col("_before") + F.col("_within")
    placed = sized.withColumn("_within", within).join(before, "_size")
    return placed.withColumns({"batch": F.floor(rank / batch), "place": (rank % batch).cast("int")}).drop("_size", "_within", "_before")


def fingerprint(config: dict[str, Any]) -> str:
    """SHA-256 of the sorted JSON text of a configuration."""
    return hashlib.sha256(json.dumps(config, sort_keys=True).encode()).hexdigest()


def utc_stamp(at: Column) -> Column:
    """An instant as ISO text in UTC, whatever the session's time zone; null for null."""
    micros = F.unix_micros(at)
    whole = F.timestamp_seconds(F.floor(micros / 1_000_000))
    local = F.convert_timezone(F.current_timezone(), F.lit("UTC"), whole.cast("timestamp_ntz"))
    return F.date_format(local, "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
