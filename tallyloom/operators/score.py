"""Encoding with a cache per row, standardising, linear heads, answers, temperatures and prediction records."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import prob
from tallyloom.functions.text import hashed_grams
from tallyloom.schema import BINARY, CHOICE, ORDINAL

EPSILON = 1e-6


def hashed_encoder(rows: DataFrame, buckets: int = 1 << 14) -> DataFrame:
    """The deterministic encoder of tests: ``row_sha256, features`` as sorted bucket numbers of tokens and pairs."""
    return rows.select("row_sha256", hashed_grams(F.col("text"), buckets).alias("features"))


def encode_cached(rows: DataFrame, path: str, fingerprint: str, encoder: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Features of every distinct row hash, from the cache at ``path`` where it has them; the rest is encoded and added.

    The cache is Parquet, partitioned by the encoder's fingerprint, one entry per row hash: a hit needs both to agree.
    Only the misses reach the encoder. An append that is run twice adds equal entries, which reads take once.
    """
    spark = rows.sparkSession
    wanted = rows.select("row_sha256", "text").dropDuplicates(["row_sha256"])
    stored = _read_cache(spark, path, fingerprint)
    misses = wanted if stored is None else wanted.join(stored.select("row_sha256"), "row_sha256", "left_anti")
    encoder(misses).withColumn("fingerprint", F.lit(fingerprint)).write.mode("append").partitionBy("fingerprint").parquet(path)
    return wanted.select("row_sha256").join(_read_cache(spark, path, fingerprint), "row_sha256")


def _read_cache(spark, path: str, fingerprint: str) -> DataFrame | None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return None
    stored = spark.read.parquet(path)
    if "fingerprint" not in stored.columns:
        return None
    return stored.where(F.col("fingerprint").cast("string") == fingerprint).drop("fingerprint").dropDuplicates(["row_sha256"])


def moments(df: DataFrame, vector: str) -> DataFrame:
    """``dim, mean, std`` per dimension: population moments, the deviation at least ``EPSILON``. Fit on training rows only."""
    long = df.select(F.posexplode(vector).alias("dim", "x"))
    return long.groupBy("dim").agg(F.avg(F.col("x").cast("double")).alias("mean"), F.greatest(F.stddev_pop(F.col("x").cast("double")), F.lit(EPSILON)).alias("std"))


def standardize(df: DataFrame, vector: str, fitted: DataFrame | None, out: str = "standardized") -> DataFrame:
    """(x - mean) / std per dimension; the vector itself before anything is fitted. The moments are one row per dimension."""
    if fitted is None:
        return df.withColumn(out, F.transform(vector, lambda x: x.cast("double")))
    stats = sorted(fitted.select("dim", "mean", "std").collect())
    means, stds = F.array(*[F.lit(float(r["mean"])) for r in stats]), F.array(*[F.lit(float(r["std"])) for r in stats])
    return df.withColumn(out, F.zip_with(F.zip_with(vector, means, lambda x, m: x - m), stds, lambda x, s: x / s))


def linear_logits(df: DataFrame, vector: str, heads: DataFrame, by: str) -> DataFrame:
    """``logit`` of each row from the head (``weights, bias``) of its ``by``; heads are a few rows and are broadcast."""
    return df.join(F.broadcast(heads.select(by, "weights", "bias")), by).withColumn("logit", prob.dot(F.col(vector), F.col("weights")) + F.col("bias")).drop("weights", "bias")


def group_logits(rows: DataFrame) -> DataFrame:
    """Candidate rows with ``logit`` to one row per question: ``id, question_type, row_logits, candidate_ids``, in order."""
    ordered = F.array_sort(F.collect_list(F.struct(F.coalesce("candidate_index", F.lit(0)).alias("i"), "logit", "candidate_id")))
    return rows.groupBy("id", "question_type").agg(ordered.alias("c")).select("id", "question_type", F.col("c.logit").alias("row_logits"), F.col("c.candidate_id").alias("candidate_ids"))


def probabilities(kind: Column, logits: Column, temperature: Column | float = 1.0) -> Column:
    """Of a question's candidates: both sides of a sigmoid for a binary one, a softmax over the whole group otherwise."""
    p = prob.sigmoid(F.element_at(logits, 1) / temperature)
    return F.when(kind == BINARY, F.array(1 - p, p)).otherwise(prob.softmax(logits, temperature))


def question_nll(kind: Column, logits: Column, target: Column) -> Column:
    """Without a floor: from log-softmax, or softplus for a binary question."""
    return F.when(kind == BINARY, prob.binary_nll(F.element_at(logits, 1), target)).otherwise(-prob.at(prob.log_softmax(logits), target))


def question_loss(kind: Column, logits: Column, target: Column, rps_weight: float = 0.0) -> Column:
    """The training objective: NLL, plus ``rps_weight`` times the ranked probability score of an ordinal question."""
    nll = question_nll(kind, logits, target)
    return F.when(kind == ORDINAL, nll + rps_weight * prob.rps(prob.softmax(logits), target)).otherwise(nll)


def answers(df: DataFrame, *, temperature: Column | float = 1.0, threshold: float = 0.5) -> DataFrame:
    """Adds ``answer`` to rows of ``question_type, row_logits, candidate_ids, levels``.

    A binary answer is ``p``; a choice is the first option of largest probability, with all probabilities and their
    concentration; an ordinal one is the expected level, with the levels' probabilities, legend and concentration.
    """
    kind = F.col("question_type")
    named = df.withColumn("_p", probabilities(kind, F.col("row_logits"), temperature))
    p, ids = F.col("_p"), F.col("candidate_ids")
    only = lambda name, value: F.when(kind == name, value)
    answer = F.struct(
        kind.alias("type"),
        only(BINARY, F.element_at(p, 2)).alias("p"),
        only(CHOICE, prob.at(ids, prob.argmax(p))).alias("choice"),
        only(CHOICE, F.map_from_arrays(ids, p)).alias("probabilities"),
        only(ORDINAL, p).alias("level_probabilities"),
        only(ORDINAL, prob.expectation(p)).alias("score"),
        only(ORDINAL, F.col("levels")).alias("legend"),
        F.when(kind != BINARY, prob.concentration(p)).alias("confidence"),
    )
    return named.withColumn("answer", answer).drop("_p")


def correctness(kind: Column, logits: Column, target: Column, threshold: float = 0.5) -> Column:
    """Threshold for a binary question, first largest logit otherwise."""
    return F.when(kind == BINARY, (prob.sigmoid(F.element_at(logits, 1)) >= threshold) == (target == 1)).otherwise(prob.argmax(logits) == target)


def predictions(df: DataFrame, temperatures: dict[str, float] | None = None, threshold: float = 0.5) -> DataFrame:
    """Adds ``nll, correct, temperature, nll_uncalibrated, answer`` to questions with logits and target indexes."""
    kind, z, t = F.col("question_type"), F.col("row_logits"), F.col("target_index")
    scale = F.lit(1.0)
    for name, value in (temperatures or {}).items():
        scale = F.when(kind == name, F.lit(float(value))).otherwise(scale)
    scaled = F.transform(z, lambda x: x / F.col("_t"))
    out = df.withColumn("_t", scale).withColumns({"nll": question_nll(kind, scaled, t), "correct": correctness(kind, z, t, threshold), "nll_uncalibrated": question_nll(kind, z, t)})
    return answers(out, temperature=F.col("_t"), threshold=threshold).withColumnRenamed("_t", "temperature")


def answer_violations(df: DataFrame) -> DataFrame:
    """Rows whose ``answer`` breaks an invariant: probabilities outside [0, 1] or not summing to 1 within 1e-5, a choice
    that isn't an option, a score out of the rubric's range."""
    a = F.col("answer")
    sums = lambda p: prob.is_distribution(p, 1e-5) & F.forall(p, lambda x: x.between(0, 1))
    fine = (
        F.when(a["type"] == BINARY, a["p"].between(0, 1))
        .when(a["type"] == CHOICE, sums(F.map_values(a["probabilities"])) & F.array_contains(F.col("candidate_ids"), a["choice"]))
        .when(a["type"] == ORDINAL, sums(a["level_probabilities"]) & a["score"].between(F.lit(0.0), F.size(a["level_probabilities"]) - 1.0))
    )
    return df.where(~F.coalesce(fine, F.lit(False)))


def reload_difference(saved: DataFrame, again: DataFrame, tolerance: float = 1e-4) -> DataFrame:
    """``questions, max_difference, within``: largest difference of logits between saved and recomputed predictions."""
    joined = saved.select("id", F.col("row_logits").alias("a")).join(again.select("id", F.col("row_logits").alias("b")), "id")
    worst = F.array_max(F.zip_with("a", "b", lambda x, y: F.abs(x - y)))
    return joined.agg(F.count("*").alias("questions"), F.max(worst).alias("max_difference")).withColumn("within", F.col("max_difference") <= tolerance)


def robustness(original: DataFrame, variant: DataFrame, by: str = "type") -> DataFrame:
    """Before and after by type and overall: ``n, accuracy_before, accuracy_after, nll_before, nll_after, unchanged``.

    Both sides hold ``id, correct, nll, prediction``; the variant may be any altered input (options, rubric, image).
    """
    a, b = original.alias("a"), variant.alias("b")
    joined = a.join(b, F.col("a.id") == F.col("b.id")).select(F.explode(F.array(F.col(f"a.{by}"), F.lit("all"))).alias(by), "a.correct", "a.nll", F.col("b.correct").alias("correct_b"), F.col("b.nll").alias("nll_b"), F.col("a.prediction").eqNullSafe(F.col("b.prediction")).alias("same"))
    mean = lambda c, name: F.avg(F.col(c).cast("double")).alias(name)
    return joined.groupBy(by).agg(F.count("*").alias("n"), mean("correct", "accuracy_before"), mean("correct_b", "accuracy_after"), mean("nll", "nll_before"), mean("nll_b", "nll_after"), mean("same", "unchanged"))


def inspect_errors(df: DataFrame, *, seed: int = 0, correct_rows: int = 20) -> DataFrame:
    """All wrong predictions by type, family and falling NLL, then a seeded sample of ``correct_rows`` right ones."""
    wrong = df.where(~F.col("correct")).withColumn("_part", F.lit(0))
    right = df.where("correct").orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(correct_rows).withColumn("_part", F.lit(1))
    return wrong.unionByName(right).orderBy("_part", "type", "task_family", F.desc("nll"), "id").drop("_part")
