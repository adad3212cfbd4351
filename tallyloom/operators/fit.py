"""Baselines, linear heads, conditional logit and temperatures.

Gradients are sums over rows and are computed by Spark for every step; the driver holds the coefficients only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import prob
from tallyloom.operators.score import question_nll
from tallyloom.schema import BINARY, CHOICE, ORDINAL

EPS_TEMPERATURE, LEAST_QUESTIONS, SLACK = 0.01, 30, 1e-9
BUCKETS, RIDGE = 1 << 14, 0.01


def prior_baseline(train: DataFrame, label: str) -> DataFrame:
    """``positives, n, p, logit`` with Laplace's rule: (k + 1) / (n + 2)."""
    counted = train.agg(F.count_if(F.col(label) == 1).alias("positives"), F.count(label).alias("n"))
    return counted.withColumn("p", (F.col("positives") + 1.0) / (F.col("n") + 2.0)).withColumn("logit", prob.logit(F.col("p")))


def uniform_logits(df: DataFrame, size: str) -> DataFrame:
    return df.withColumn("row_logits", F.array_repeat(F.lit(0.0), F.col(size)))


def level_prior(train: DataFrame, size: str, level: str) -> DataFrame:
    """``m, level, count, logit`` for every level of each seen number of levels: ln(count + 1)."""
    counts = train.groupBy(F.col(size).alias("m"), F.col(level).alias("level")).agg(F.count("*").alias("count"))
    grid = train.select(F.col(size).alias("m")).distinct().select("m", F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("level"))
    filled = grid.join(counts, ["m", "level"], "left").withColumn("count", F.coalesce("count", F.lit(0).cast("long")))
    return filled.withColumn("logit", F.ln(F.col("count") + 1.0))


def level_prior_logits(df: DataFrame, fitted: DataFrame, size: str) -> DataFrame:
    """``row_logits`` by number of levels; uniform where training had none of that number."""
    arrays = fitted.groupBy("m").agg(F.array_sort(F.collect_list(F.struct("level", "logit"))).alias("l")).select(F.col("m").alias(size), F.col("l.logit").alias("_z"))
    return df.join(F.broadcast(arrays), size, "left").withColumn("row_logits", F.coalesce("_z", F.array_repeat(F.lit(0.0), F.col(size)))).drop("_z")


def bow_logistic(train: DataFrame, features: str, label: str, *, buckets: int = BUCKETS, ridge: float = RIDGE, iterations: int = 200):
    """Logistic regression on binary hashed features with the penalty ``ridge * sum(w^2)``; the intercept is free.

    Spark penalises half of ``regParam``, hence twice the value. Returns the fitted Spark model.
    """
    from pyspark.ml.classification import LogisticRegression

    fit = LogisticRegression(featuresCol="_v", labelCol="_y", regParam=2 * ridge, elasticNetParam=0.0, standardization=False, maxIter=iterations, tol=1e-9)
    return fit.fit(sparse_vectors(train, features, buckets).select("_v", F.col(label).cast("double").alias("_y")))


def sparse_vectors(df: DataFrame, features: str, buckets: int) -> DataFrame:
    """``df`` with ``_v``, the binary vector of the bucket numbers in ``features``; the buckets are a vocabulary of numbers."""
    from pyspark.ml.feature import CountVectorizerModel

    named = df.withColumn("_w", F.transform(F.coalesce(F.col(features), F.array().cast("array<int>")), lambda i: i.cast("string")))
    numbers = CountVectorizerModel.from_vocabulary([str(i) for i in range(buckets)], inputCol="_w", outputCol="_v", binary=True)
    return numbers.transform(named).drop("_w")


def _sums(weights: np.ndarray, lists) -> np.ndarray:
    """The sum of the weights that each list of buckets names; a null list names none."""
    sizes = np.array([0 if x is None else len(x) for x in lists])
    named = [x for x in lists if x is not None and len(x)]
    flat = np.concatenate(named).astype(np.int64) if named else np.zeros(0, dtype=np.int64)
    return np.bincount(np.repeat(np.arange(len(sizes)), sizes), weights=weights[flat], minlength=len(sizes))


def bow_logits(model, df: DataFrame, features: str, *, buckets: int = BUCKETS) -> DataFrame:
    """``df`` with ``logit``: the intercept and the weights of a row's buckets; null where ``features`` is."""
    sent, bias = df.sparkSession.sparkContext.broadcast(model.coefficients.toArray()), float(model.intercept)
    score = F.pandas_udf(lambda s: pd.Series(bias + _sums(sent.value, s)), "double")
    return df.withColumn("logit", F.when(F.col(features).isNotNull(), score(F.coalesce(F.col(features), F.array().cast("array<int>")))))


def _minimise(objective: Callable[[np.ndarray], tuple[float, np.ndarray]], start: np.ndarray, steps: int, memory: int = 8, tolerance: float = 1e-8) -> np.ndarray:
    """Limited-memory BFGS with a halving line search; each evaluation is one pass over the data."""
    x = start.copy()
    value, slope = objective(x)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        if np.abs(slope).max(initial=0) < tolerance:
            break
        q, alphas = slope.copy(), []
        for s, y in reversed(past):
            a = (s @ q) / (y @ s)
            alphas.append(a)
            q -= a * y
        if past:
            s, y = past[-1]
            q *= (s @ y) / (y @ y)
        for (s, y), a in zip(past, reversed(alphas)):
            q += (a - (y @ q) / (y @ s)) * s
        size = 1.0 if past else min(1.0, 1.0 / np.abs(slope).sum())
        for _ in range(25):
            new = x - size * q
            new_value, new_slope = objective(new)
            if new_value <= value - 1e-4 * size * (slope @ q):
                break
            size /= 2
        else:
            break
        if (new - x) @ (new_slope - slope) > 1e-12:
            past = [*past, (new - x, new_slope - slope)][-memory:]
        x, value, slope = new, new_value, new_slope
    return x


def group_losses(z: np.ndarray, ends: np.ndarray, target: np.ndarray, rps_weight: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Each question's loss, and the loss's derivative by each candidate's logit; a question's candidates end at ``ends``.

    Questions of all lengths are handled together by sums over their stretches.
    """
    sizes = np.diff(ends, prepend=0)
    starts = ends - sizes
    question = np.repeat(np.arange(len(ends)), sizes)
    p = np.exp(z - np.maximum.reduceat(z, starts)[question])
    p /= np.add.reduceat(p, starts)[question]
    own = starts + target
    loss, pull = -np.log(np.maximum(p[own], prob.FLOOR)), p.copy()
    pull[own] -= 1
    if rps_weight:
        place = np.arange(len(z)) - starts[question]
        summed = np.cumsum(p)
        until = summed - (summed[starts] - p[starts])[question]
        last = place == (sizes - 1)[question]
        miss = np.where(last, 0.0, until - (target[question] <= place))
        share = np.maximum(1, sizes - 1)
        loss = loss + rps_weight * np.add.reduceat(miss**2, starts) / share
        step = 2 * miss / share[question]
        passed = np.cumsum(step) - step
        back = np.add.reduceat(step, starts)[question] - (passed - passed[starts][question])
        pull += rps_weight * p * (back - np.add.reduceat(p * back, starts)[question])
    return loss, pull


def conditional_logit(groups: DataFrame, features: str, target: str, dimensions: int, *, ridge: float = RIDGE, rps_weight: float = 0.0, steps: int = 60, dense: bool = False) -> np.ndarray:
    """Weights of one linear score per candidate that maximise the likelihood of the target among its group.

    ``features`` holds for each candidate of a question its active buckets (or, ``dense``, its vector). Every evaluation
    sums loss and gradient within the partitions and adds one vector per partition.
    """
    spark = groups.sparkSession
    rows = groups.select(F.col(features).alias("x"), F.col(target).alias("t")).persist()
    n = rows.count()

    def objective(w: np.ndarray) -> tuple[float, np.ndarray]:
        sent = spark.sparkContext.broadcast(w)

        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            loss, slope = 0.0, np.zeros(dimensions)
            for batch in batches:
                if not batch.num_rows:
                    continue
                groups = batch.column("x")
                ends = np.cumsum(groups.value_lengths().to_numpy(zero_copy_only=False))
                candidates = groups.flatten()
                sizes = candidates.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
                flat = candidates.flatten().to_numpy(zero_copy_only=False)
                owner = np.repeat(np.arange(len(sizes)), sizes)
                x = flat.astype(np.float64).reshape(-1, dimensions) if dense else flat.astype(np.int64)
                z = x @ sent.value if dense else np.bincount(owner, weights=sent.value[x], minlength=len(sizes))
                told, pull = group_losses(z, ends, batch.column("t").to_numpy(zero_copy_only=False).astype(np.int64), rps_weight)
                loss += float(told.sum())
                slope += pull @ x if dense else np.bincount(x, weights=pull[owner], minlength=dimensions)
            at = np.flatnonzero(slope)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(slope[at], loss))], ["i", "v"])

        summed = rows.mapInArrow(part, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
        slope, loss = np.zeros(dimensions), 0.0
        for r in summed:
            if r.i < 0:
                loss = r.v
            else:
                slope[r.i] = r.v
        sent.unpersist()
        return loss / max(1, n) + ridge * float(w @ w), slope / max(1, n) + 2 * ridge * w

    try:
        return _minimise(objective, np.zeros(dimensions), steps)
    finally:
        rows.unpersist()


def temperature_grid(df: DataFrame, logits: str, target: str, kind: str, temperatures: list[float]) -> DataFrame:
    """``kind, temperature, n, nll``: mean NLL of every question at each temperature, in one pass."""
    t = F.col("_t")
    at = df.withColumn("_t", F.explode(F.array(*[F.lit(float(x)) for x in temperatures])))
    return at.groupBy(F.col(kind).alias("kind"), t.alias("temperature")).agg(F.count("*").alias("n"), F.avg(question_nll(F.col(kind), F.transform(logits, lambda z: z / t), F.col(target))).alias("nll"))


def fit_temperatures(df: DataFrame, logits: str = "row_logits", target: str = "target_index", kind: str = "question_type", *, rounds: int = 6, points: int = 9) -> dict[str, dict]:
    """``{type: temperature, n, calibrated, nll_before, nll_after}``: T = softplus(t) + 0.01 of least mean NLL, per type.

    Types of fewer than 30 questions keep T = 1 and are not calibrated. The search narrows a grid around the best value,
    all types in one pass a round. A fit that doesn't lower the NLL keeps T = 1.
    """
    start = float(np.log(np.expm1(1 - EPS_TEMPERATURE)))
    counts = {r[0]: r[1] for r in df.groupBy(kind).count().collect()}
    centre, width = {k: start for k in counts}, 6.0
    before = {r.kind: r.nll for r in temperature_grid(df, logits, target, kind, [1.0]).collect()}
    best: dict[str, tuple[float, float]] = {k: (1.0, before[k]) for k in counts}
    for _ in range(rounds):
        grid = {k: [float(np.logaddexp(0, c + width * (2 * i / (points - 1) - 1)) + EPS_TEMPERATURE) for i in range(points)] for k, c in centre.items()}
        every = sorted({t for ts in grid.values() for t in ts})
        for r in temperature_grid(df, logits, target, kind, every).collect():
            if r.nll is not None and r.nll < best[r.kind][1] - 1e-15:
                best[r.kind] = (r.temperature, r.nll)
        centre = {k: float(np.log(np.expm1(max(1e-6, best[k][0] - EPS_TEMPERATURE)))) for k in counts}
        width /= (points - 1) / 2.5
    out = {}
    for k, n in counts.items():
        use = n >= LEAST_QUESTIONS and best[k][1] <= before[k] + SLACK
        out[k] = {"temperature": best[k][0] if use else 1.0, "n": n, "calibrated": use, "nll_before": before[k], "nll_after": best[k][1] if use else before[k]}
    return out


def baseline_logits(train: DataFrame, df: DataFrame) -> DataFrame:
    """``row_logits`` of the prior baselines for all types, fitted on ``train`` only.

    Both hold ``question_type, n_candidates, target_index``: the positive prior for binary questions, uniform for
    choices, level counts for ordinal ones.
    """
    z = prior_baseline(train.where(F.col("question_type") == BINARY), "target_index").first()["logit"]
    binary = df.where(F.col("question_type") == BINARY).withColumn("row_logits", F.array(F.lit(float(z))))
    choice = uniform_logits(df.where(F.col("question_type") == CHOICE), "n_candidates")
    fitted = level_prior(train.where(F.col("question_type") == ORDINAL), "n_candidates", "target_index")
    return binary.unionByName(choice).unionByName(level_prior_logits(df.where(F.col("question_type") == ORDINAL), fitted, "n_candidates"), allowMissingColumns=True)


def bag_baseline(train: DataFrame, df: DataFrame, features: str = "features", *, buckets: int = BUCKETS, ridge: float = RIDGE, steps: int = 60) -> DataFrame:
    """``row_logits`` of the hashed-bag baselines for all types, each fitted on ``train``'s questions of its type only.

    Both hold ``question_type, target_index`` and in ``features`` the buckets of each candidate. Binary questions get a
    logistic regression over their one candidate, choices and ordinal ones a weight per bucket shared by a question's
    candidates. A type that ``train`` has no question of, or for a binary one no two labels, gets zeros. The three
    models (a number a bucket each) go to the tasks; the rows of ``df`` stay where they are.
    """
    counts = {(r[0], r[1]): r[2] for r in train.groupBy("question_type", F.when(F.col("question_type") == BINARY, F.col("target_index"))).count().collect()}
    models: dict[str, tuple[np.ndarray, float]] = {}
    if counts.get((BINARY, 0)) and counts.get((BINARY, 1)):
        fitted = bow_logistic(train.where(F.col("question_type") == BINARY).withColumn("_f", F.element_at(features, 1)), "_f", "target_index", buckets=buckets, ridge=ridge)
        models[BINARY] = (fitted.coefficients.toArray(), float(fitted.intercept))
    for kind in (CHOICE, ORDINAL):
        if counts.get((kind, None)):
            models[kind] = (conditional_logit(train.where(F.col("question_type") == kind), features, "target_index", buckets, ridge=ridge, steps=steps), 0.0)
    sent = df.sparkSession.sparkContext.broadcast(models)

    def score(lists: pd.Series, kinds: pd.Series) -> pd.Series:
        out = [None] * len(lists)
        for kind in kinds.unique():
            at = np.flatnonzero((kinds == kind).to_numpy())
            weights, bias = sent.value.get(kind, (np.zeros(buckets), 0.0))
            told = [x for i in at for x in lists.iloc[i]]
            logits, start = bias + _sums(weights, told), 0
            for i in at:
                out[i] = logits[start : start + len(lists.iloc[i])].tolist()
                start += len(lists.iloc[i])
        return pd.Series(out)

    return df.withColumn("row_logits", F.pandas_udf(score, "array<double>")(F.col(features), F.col("question_type")))


def overfit_gate(accuracy: float, nll: float, *, most_nll: float = 0.05) -> None:
    """Training on a handful of rows must fit them: accuracy 1 and a small NLL."""
    if accuracy < 1 or nll >= most_nll:
        raise ValueError(f"the model does not fit its training rows: accuracy {accuracy}, NLL {nll}")


def best_epoch(history: DataFrame) -> DataFrame:
    """The first epoch of least validation NLL from ``epoch, nll``."""
    return history.agg(F.min_by("epoch", F.struct("nll", "epoch")).alias("epoch"), F.min("nll").alias("nll"))
