"""Decisions on requests: one pure function from requests to answers, for batch frames and for streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallyloom import schema as S
from tallyloom.functions import prob

MAX_QUESTIONS, MAX_BODY, TIMEOUT_S = 8, 8 * 1024 * 1024, 120
#: A request as JSON text: id, state, and questions by id.
REQUEST = "struct<id:string,state:string,questions:map<string,struct<type:string,instructions:string,options:array<string>,levels:array<string>>>>"


def parse_requests(df: DataFrame, body: str = "value") -> DataFrame:
    """``id, request, error`` from JSON bodies: too large, not JSON (or not finite, or a key twice), or against the rules.

    The error never repeats the input.
    """
    large = F.octet_length(body) > MAX_BODY
    request = F.from_json(F.when(F.try_parse_json(F.col(body)).isNotNull(), F.col(body)), REQUEST)  # null if the strict parse fails
    read = F.struct(F.coalesce(large, F.lit(False)).alias("large"), F.when(~large, request).alias("r"))
    # a generator: what is asked of the request later isn't pushed before it, where each use would parse the body again
    parsed = df.select(F.explode(F.array(read)).alias("_p")).select(F.col("_p.large").alias("_large"), F.col("_p.r").alias("_r"))
    questions = F.map_values("_r.questions")
    wrong = F.exists(questions, lambda q: ~F.coalesce(q["type"].isin(*S.TYPES), F.lit(False)) | F.coalesce(F.length(F.trim(q["instructions"])) == 0, F.lit(True)) | ((q["type"] == S.CHOICE) & ~F.coalesce(F.size(q["options"]).between(*S.CHOICE_OPTIONS), F.lit(False))) | ((q["type"] == S.ORDINAL) & ~F.coalesce(F.size(q["levels"]).between(*S.ORDINAL_LEVELS), F.lit(False))))
    error = (
        F.when(F.col("_large"), "body_too_large")
        .when(F.col("_r").isNull(), "invalid_json")
        .when(F.coalesce(F.length(F.trim("_r.state")), F.lit(0)) == 0, "empty_state")
        .when(~F.coalesce(F.size("_r.questions").between(1, MAX_QUESTIONS), F.lit(False)), "question_count")
        .when(wrong, "invalid_question")
    )
    return parsed.select(F.col("_r.id").alias("id"), F.when(error.isNull(), F.col("_r")).alias("request"), error.alias("error"))


def decide(requests: DataFrame, score: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """One row per question: ``id, question_id, question_type, p, answer, expanded_rows``.

    ``score`` adds ``row_logits``, one logit per candidate (a binary question has one), to rows of ``id, question_id,
    state, question``; it must be a row expression, so that what else is asked never changes an answer. Nothing here
    needs state or a shuffle, so the function gives the same rows on a batch and on a stream.
    """
    asked = requests.where("error IS NULL").select("id", "request.state", F.explode("request.questions").alias("question_id", "question"))
    scored = score(asked)
    kind, z = F.col("question.type"), F.col("row_logits")
    p = F.when(kind == S.BINARY, F.array(prob.sigmoid(F.element_at(z, 1)))).otherwise(prob.softmax(z))
    answer = F.when(kind == S.BINARY, F.when(F.element_at("p", 1) >= 0.5, "yes").otherwise("no")).when(kind == S.CHOICE, F.get("question.options", prob.argmax(F.col("p")))).otherwise(F.round(prob.expectation(F.col("p")), 6).cast("string"))
    return scored.withColumn("p", p).select("id", "question_id", kind.alias("question_type"), "p", answer.alias("answer"), F.size(z).alias("expanded_rows"))


def hashed_scorer(df: DataFrame) -> DataFrame:
    """The deterministic scorer of tests: a logit within [-2, 2] from the MD5 of state, instructions and candidate."""
    q = F.col("question")
    candidates = F.when(q["type"] == S.BINARY, F.array(F.lit(""))).when(q["type"] == S.CHOICE, q["options"]).otherwise(q["levels"])
    return df.withColumn("row_logits", F.transform(candidates, lambda c: F.conv(F.substring(F.md5(F.concat_ws("\n", "state", q["instructions"], c)), 1, 8), 16, 10).cast("long") % 4001 / 1000.0 - 2))


def usage(decisions: DataFrame) -> DataFrame:
    """``requests, questions, expanded_rows, forwards, generated_tokens`` of decided questions."""
    return decisions.agg(F.count_distinct("id").alias("requests"), F.count("*").alias("questions"), F.sum("expanded_rows").alias("expanded_rows"), F.sum("expanded_rows").alias("forwards"), F.lit(0).cast("long").alias("generated_tokens"))


def decide_stream(source: DataFrame, score: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str, *, body: str = "value", available_now: bool = True) -> StreamingQuery:
    """Decide a stream of request bodies into Parquet at ``sink``; offsets and commits are kept at ``checkpoint``.

    The queue of a front end becomes the source's own rate limit (such as ``maxFilesPerTrigger``): it delays requests
    and never rejects them.
    """
    writer = decide(parse_requests(source, body), score).writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def warm_up(spark, score: Callable[[DataFrame], DataFrame]) -> bool:
    """Decide one real request; ready once its answer is there."""
    body = '{"id": "warm-up", "state": "ready", "questions": {"q": {"type": "binary", "instructions": "Ready?"}}}'
    return decide(parse_requests(spark.createDataFrame([(body,)], "value string")), score).count() == 1
