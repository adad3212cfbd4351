"""A served stream with exact accounts: every request is counted once and every request id answered once.

A request's id is remembered in the stream's state, so a repetition is counted as such and not decided again, whichever
batch it comes in. A batch's answers and its account are written under the batch's number, whole files replacing what an
earlier attempt left; the account is written last and is what makes the answers count. A batch that dies before Spark
commits it comes again with the same number and the same requests, and so replaces itself.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tallyloom.sources.sinks import read_text
from tallyloom.sources.snapshots import put_text
from tallyloom.streaming.decide import decide, parse_requests

#: Milliseconds for which a request's id is remembered after it was last seen.
HORIZON_MS = 24 * 3600 * 1000
NO_DATA_BATCHES = "spark.sql.streaming.noDataMicroBatches.enabled"
ACCOUNT = "batch long, received long, repeated long, refused long, answered long, questions long, expanded_rows long, errors map<string,long>"


def _remember(horizon_ms: int):
    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        known = state.exists
        for part in parts:
            first = pd.Series(False, index=part.index)
            if key[0] is None:  # requests without an id are not each other's repetitions
                first[:] = True
            elif not known and len(part):
                first.iloc[0] = True
                known = True
            yield pd.DataFrame({"value": part["value"], "first": first})
        if key[0] is not None:
            state.update((True,))
            state.setTimeoutDuration(horizon_ms)

    return run


def mark_repeated(source: DataFrame, body: str = "value", horizon_ms: int = HORIZON_MS) -> DataFrame:
    """``value, first`` of every request of a stream: whether its id was not seen before, within ``horizon_ms``.

    Of several requests of one id in a batch, one is the first. A body without a readable id stands for itself.
    """
    keyed = source.select(F.col(body).cast("string").alias("value"), F.get_json_object(body, "$.id").alias("_id"))
    return keyed.groupBy("_id").applyInPandasWithState(_remember(horizon_ms), "value string, first boolean", "seen boolean", "append", GroupStateTimeout.ProcessingTimeTimeout)


def write_batch(score: Callable[[DataFrame], DataFrame], sink: str):
    """A batch's writer: answers to ``answers/batch=N``, then the account to ``accounts/N.json``."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.persist()
        try:
            parsed = parse_requests(rows.where("first"), "value")
            decide(parsed, score).write.mode("overwrite").parquet(f"{sink}/answers/batch={number}")
            told = rows.agg(F.count("*").alias("received"), F.count_if(~F.col("first")).alias("repeated")).first()
            errors = {r["error"]: r["n"] for r in parsed.where("error IS NOT NULL").groupBy("error").agg(F.count("*").alias("n")).collect()}
            answers = spark.read.parquet(f"{sink}/answers/batch={number}").agg(F.count("*").alias("questions"), F.coalesce(F.sum("expanded_rows"), F.lit(0)).alias("expanded_rows")).first()
            refused = sum(errors.values())
            account = {"batch": number, "received": told["received"], "repeated": told["repeated"], "refused": refused, "answered": told["received"] - told["repeated"] - refused, "questions": answers["questions"], "expanded_rows": answers["expanded_rows"], "errors": errors}
            put_text(spark, f"{sink}/accounts", f"{number}.json", json.dumps(account))
        finally:
            rows.unpersist()

    return write


def serve_stream(source: DataFrame, score: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str, *, body: str = "value", horizon_ms: int = HORIZON_MS, available_now: bool = True, writer: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Decide a stream of request bodies into ``sink``, with accounts. ``sink`` belongs to one ``checkpoint`` for good.

    A ``ValueError`` refuses a sink that another checkpoint has written to. ``writer`` replaces ``write_batch``'s.
    """
    spark = source.sparkSession
    owner = read_text(spark, f"{sink}/owner.json")
    if owner is None:
        put_text(spark, sink, "owner.json", json.dumps({"checkpoint": checkpoint}))
    elif json.loads(owner)["checkpoint"] != checkpoint:
        raise ValueError(f"{sink} holds the answers of another stream")
    stream = mark_repeated(source, body, horizon_ms).writeStream.foreachBatch(writer or write_batch(score, sink)).outputMode("append").option("checkpointLocation", checkpoint)
    # ids are forgotten when a batch comes: batches without data would follow each other for ever (the query copies the setting)
    before = spark.conf.get(NO_DATA_BATCHES)
    spark.conf.set(NO_DATA_BATCHES, "false")
    try:
        return (stream.trigger(availableNow=True) if available_now else stream).start()
    finally:
        spark.conf.set(NO_DATA_BATCHES, before)


def accounts(spark: SparkSession, sink: str) -> DataFrame:
    """One row for each batch that was written to its end: requests received, repeated, refused (by code) and answered."""
    return spark.read.schema(ACCOUNT).option("mode", "FAILFAST").option("pathGlobFilter", "*.json").json(f"{sink}/accounts")


def answers(spark: SparkSession, sink: str) -> DataFrame:
    """The answers of all batches that have an account."""
    rows = spark.read.option("basePath", f"{sink}/answers").parquet(f"{sink}/answers")
    return rows.join(F.broadcast(accounts(spark, sink).select("batch")), "batch", "left_semi")  # a number a batch


def totals(spark: SparkSession, sink: str) -> DataFrame:
    """``batches, received, repeated, refused, answered, questions, expanded_rows`` over all batches; they survive a restart."""
    names = ("received", "repeated", "refused", "answered", "questions", "expanded_rows")
    return accounts(spark, sink).agg(F.count("*").alias("batches"), *(F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names))
