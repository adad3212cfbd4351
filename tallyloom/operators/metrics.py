"""Proper-scoring metrics as aggregates: binary, choice and ordinal, calibration error, pairwise order, latency.

Breakdowns come from one pass: a row is expanded to the grouping sets it belongs to, before the partial aggregation.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import prob

ALL = "all"


def _sets(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Each row once for the whole table (nulls in ``by``) and once for each leading part of ``by``."""
    sets = [F.struct(*[(F.col(c).cast("string") if i < n else F.lit(None).cast("string")).alias(c) for i, c in enumerate(by)]) for n in range(len(by) + 1)]
    return df.withColumn("_set", F.explode(F.array(*sets))) if by else df.withColumn("_set", F.struct(F.lit(1).alias("one")))


def _unset(df: DataFrame, by: Sequence[str]) -> DataFrame:
    return df.select(*(F.col(f"_set.{c}").alias(c) for c in by), *(c for c in df.columns if c != "_set"))


def reliability(df: DataFrame, p: str, y: str, *, bins: int = prob.BINS, by: Sequence[str] = ()) -> DataFrame:
    """Equal bins with ``n, mean_p, frequency``; empty bins are listed with nulls (for the whole table, without ``by``)."""
    filled = df.groupBy(*by, prob.bin_index(F.col(p), bins).alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("mean_p"), F.avg(F.col(y).cast("double")).alias("frequency"))
    if by:
        return filled
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(filled, "bin", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def calibration_error(df: DataFrame, p: str, y: str, *, bins: int = prob.BINS, by: Sequence[str] = ()) -> DataFrame:
    """``ece`` for the whole table or each group of ``by``: the bins' gaps weighted by their share; empty bins add 0."""
    filled = reliability(df, p, y, bins=bins, by=by).where("n > 0")
    gap = F.sum(F.col("n") * F.abs(F.col("mean_p") - F.col("frequency"))) / F.sum("n")
    return filled.groupBy(*by).agg(gap.alias("ece"))


def binary_metrics(df: DataFrame, logit: str, label: str, *, threshold: float = 0.5, by: Sequence[str] = ()) -> DataFrame:
    """``n, positives, prevalence, nll, brier, ece, accuracy, precision, recall, f1`` overall and for each part of ``by``.

    Predictions are positive from the threshold on. Precision, recall and F1 are null where they are undefined. Rows
    with a null logit or label are left out. Without rows there is no result row.
    """
    z, y = F.col(logit), F.col(label)
    rows = _sets(df.where(z.isNotNull() & y.isNotNull()), by)
    rows = rows.select("_set", z.cast("double").alias("z"), y.cast("int").alias("y")).withColumn("p", prob.sigmoid(F.col("z")))
    said = F.col("p") >= threshold
    counted = rows.groupBy("_set").agg(
        F.count("*").alias("n"),
        F.sum("y").cast("long").alias("positives"),
        F.avg(F.col("y").cast("double")).alias("prevalence"),
        F.avg(prob.binary_nll(F.col("z"), F.col("y"))).alias("nll"),
        F.avg(F.pow(F.col("p") - F.col("y"), F.lit(2))).alias("brier"),
        F.avg((said == (F.col("y") == 1)).cast("double")).alias("accuracy"),
        F.count_if(said & (F.col("y") == 1)).alias("tp"),
        F.count_if(said & (F.col("y") == 0)).alias("fp"),
        F.count_if(~said & (F.col("y") == 1)).alias("fn"),
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    both = (tp + fp > 0) & (tp + fn > 0)
    scored = counted.withColumns({"precision": prob.safe_div(tp, tp + fp), "recall": prob.safe_div(tp, tp + fn), "f1": F.when(both, prob.safe_div(2 * tp, 2 * tp + fp + fn))})
    gaps = calibration_error(rows, "p", "y", by=["_set"])
    return _unset(scored.join(gaps, "_set").select("_set", "n", "positives", "prevalence", "nll", "brier", "ece", "accuracy", "precision", "recall", "f1"), by)


def _checked(df: DataFrame, probs: str) -> Column:
    return F.when(prob.is_distribution(F.col(probs)), F.col(probs)).otherwise(F.raise_error(F.lit("a distribution is not finite or does not sum to 1")))


def choice_metrics(df: DataFrame, probs: str, target: str, *, by: Sequence[str] = ("k",)) -> DataFrame:
    """``n, nll, brier_sum, accuracy, ece, mean_concentration, uniform_nll`` overall and by number of options (``k``).

    A row whose probabilities are not finite or do not sum to 1 fails the query.
    """
    named = df.select(*[c for c in by if c != "k"], _checked(df, probs).alias("p"), F.col(target).alias("t")).withColumn("k", F.size("p"))
    p, t = F.col("p"), F.col("t")
    measured = named.select(
        *by,
        F.col("k").alias("_k"),
        prob.choice_nll(p, t).alias("nll"),
        prob.brier_sum(p, t).alias("brier"),
        (prob.argmax(p) == t).cast("double").alias("correct"),
        F.array_max(p).alias("confidence"),
        prob.concentration(p).alias("concentration"),
    )
    rows = _sets(measured, by)
    counted = rows.groupBy("_set").agg(
        F.count("*").alias("n"),
        F.avg("nll").alias("nll"),
        F.avg("brier").alias("brier_sum"),
        F.avg("correct").alias("accuracy"),
        F.avg("concentration").alias("mean_concentration"),
        F.avg(F.ln(F.col("_k").cast("double"))).alias("uniform_nll"),
    )
    return _unset(counted.join(calibration_error(rows, "confidence", "correct", by=["_set"]), "_set"), by)


def ordinal_metrics(df: DataFrame, probs: str, target: str, *, by: Sequence[str] = ("m",)) -> DataFrame:
    """``n, nll, rps, mae, mae_norm, accuracy, mean_concentration, uniform_nll`` overall and by number of levels (``m``)."""
    named = df.select(*[c for c in by if c != "m"], _checked(df, probs).alias("p"), F.col(target).alias("t")).withColumn("m", F.size("p"))
    p, t = F.col("p"), F.col("t")
    off = F.abs(prob.expectation(p) - t)
    measured = named.select(
        *by,
        F.col("m").alias("_m"),
        prob.choice_nll(p, t).alias("nll"),
        prob.rps(p, t).alias("rps"),
        off.alias("mae"),
        (off / (F.size(p) - 1)).alias("mae_norm"),
        (prob.argmax(p) == t).cast("double").alias("correct"),
        prob.concentration(p).alias("concentration"),
    )
    return _unset(
        _sets(measured, by)
        .groupBy("_set")
        .agg(
            F.count("*").alias("n"),
            *(F.avg(c).alias(c) for c in ("nll", "rps", "mae", "mae_norm")),
            F.avg("correct").alias("accuracy"),
            F.avg("concentration").alias("mean_concentration"),
            F.avg(F.ln(F.col("_m").cast("double"))).alias("uniform_nll"),
        ),
        by,
    )


def cumulative_events(df: DataFrame, probs: str, target: str) -> DataFrame:
    """``(p, y)`` of every event "the level is at most j"."""
    events = F.transform(prob.cumulative(F.col(probs)), lambda c, j: F.struct(F.least(F.lit(1.0), F.greatest(F.lit(0.0), c)).alias("p"), (F.col(target) <= j).cast("int").alias("y")))
    return df.select(F.explode(events).alias("e")).select("e.p", "e.y")


def within_group_pairwise(df: DataFrame, group: str, logit: str, label: str) -> DataFrame:
    """``pairs`` of a positive and a negative of one group and ``pairwise_accuracy``: how often the positive's logit is
    the larger, ties counting half; null without pairs.

    Pairs are counted by ranks, not listed: a positive wins against the negatives below it in its group. Equal logits
    are summed before the running count, so a large group costs a sort of its distinct logits.
    """
    from pyspark.sql import Window

    levels = df.groupBy(group, F.col(logit).alias("_z")).agg(F.count_if(F.col(label) == 1).alias("_pos"), F.count_if(F.col(label) == 0).alias("_neg"))
    below = Window.partitionBy(group).orderBy("_z").rowsBetween(Window.unboundedPreceding, -1)
    won = F.col("_pos") * (F.coalesce(F.sum("_neg").over(below), F.lit(0)) + F.col("_neg") / 2)
    groups = levels.withColumn("_won", won).groupBy(group).agg(F.sum("_won").alias("_won"), (F.sum("_pos") * F.sum("_neg")).alias("_pairs"))
    return groups.agg(F.coalesce(F.sum("_pairs"), F.lit(0)).alias("pairs"), prob.safe_div(F.sum("_won"), F.sum("_pairs")).alias("pairwise_accuracy"))


def mean_nll_by_type(df: DataFrame, types: Sequence[str], *, type_col: str = "type", nll_col: str = "nll") -> DataFrame:
    """``type, n, nll`` for ``all`` and every type of the fixed list; null for those without rows."""
    spark = df.sparkSession
    counted = _sets(df.select(F.col(type_col).alias("type"), F.col(nll_col).alias("nll")), ["type"]).groupBy("_set").agg(F.count("*").alias("n"), F.avg("nll").alias("nll"))
    named = counted.select(F.coalesce("_set.type", F.lit(ALL)).alias("type"), "n", "nll")
    fixed = spark.createDataFrame([(t,) for t in (ALL, *types)], "type string")
    return fixed.join(named, "type", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def nearest_index(values: Column, q: float) -> Column:
    """The sorted list's element at ``round(q (n - 1))``, half to even."""
    ordered = F.array_sort(values)
    return F.element_at(ordered, F.bround(F.lit(q) * (F.size(ordered) - 1)).cast("int") + 1)


#: Accuracy of the quantile sketch, and how far from a quantile the values are that are ranked exactly: ten times its error.
_SKETCH, _AROUND = 10_000, 0.001
#: Rows of a group up to which all of it are ordered: there, places round to outside the bounds.
_FEW = 4_000


def values_at(df: DataFrame, value: str, ranks: dict[str, tuple[float, Callable[[Column], Column]]], by: Sequence[str] = ()) -> DataFrame:
    """``*by`` and one column per name of ``ranks``: the value at the sorted place ``rounding(q (n - 1))``, nulls left out.

    Exact: a sketch per group gives bounds on both sides of each quantile, which hold its place by the sketch's
    guaranteed error. Values below the bounds are counted, and only those within (one in 500) are ordered.
    """
    from pyspark.sql import Window

    keys = list(by) or ["_all_rows"]
    rows = df.where(F.col(value).isNotNull()).select(*by, F.col(value).alias("_v"))
    rows = rows if by else rows.withColumn("_all_rows", F.lit(0))
    edges = [F.lit(min(1.0, max(0.0, q + side))) for q, _ in ranks.values() for side in (-_AROUND, _AROUND)]
    sketch = F.percentile_approx("_v", F.array(*edges), _SKETCH)
    ends = F.array(*[side for _ in ranks for side in (F.min("_v"), F.max("_v"))])
    bounds = rows.groupBy(*keys).agg(F.count("*").alias("_n"), F.when(F.count("*") <= _FEW, ends).otherwise(sketch).alias("_edges")).withColumnsRenamed({k: f"_of_{k}" for k in keys})
    same = reduce(lambda a, k: a & F.col(k).eqNullSafe(F.col(f"_of_{k}")), keys, F.lit(True))
    one = (lambda frame: frame) if by else F.broadcast  # without keys the bounds are one row
    placed = rows.join(one(bounds), same).drop(*(f"_of_{k}" for k in keys))
    low, high = (lambda i: F.col("_edges")[2 * i]), (lambda i: F.col("_edges")[2 * i + 1])
    below = placed.groupBy(*keys).agg(F.first("_n").alias("_n"), *(F.count_if(F.col("_v") < low(i)).alias(f"_below_{i}") for i in range(len(ranks))))
    inside = F.array_compact(F.array(*[F.when(F.col("_v").between(low(i), high(i)), i) for i in range(len(ranks))]))
    near = placed.select(*keys, "_v", F.explode(inside).alias("_q")).groupBy(*keys, "_q", "_v").agg(F.count("*").alias("_c"))
    upto = F.sum("_c").over(Window.partitionBy(*keys, "_q").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    counted = near.withColumn("_upto", upto).join(one(below.withColumnsRenamed({k: f"_of_{k}" for k in keys})), same)
    place = [rounding(F.lit(q) * (F.col("_n") - 1)).cast("long") for q, rounding in ranks.values()]
    found = [F.min(F.when((F.col("_q") == i) & (F.col("_upto") + F.col(f"_below_{i}") > place[i]), F.col("_v"))).alias(name) for i, name in enumerate(ranks)]
    return counted.groupBy(*keys).agg(*found).select(*by, *ranks)


def nearest_rank(df: DataFrame, value: str, quantiles: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """The same for a long column: one column ``q<percent>`` per quantile, without gathering a group's values."""
    return values_at(df, value, {f"q{round(q * 100)}": (q, F.bround) for q in quantiles}, by)


def latency_summary(df: DataFrame, value: str, *, by: Sequence[str] = ()) -> DataFrame:
    """``n, mean, p50, p95, max`` of latencies; percentiles by nearest index."""
    counted = df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.max(value).alias("max"))
    ranks = nearest_rank(df, value, (0.5, 0.95), by).withColumnsRenamed({"q50": "p50", "q95": "p95"})
    joined = counted.join(ranks, list(by)) if by else counted.crossJoin(F.broadcast(ranks))
    return joined.select(*by, "n", "mean", "p50", "p95", "max")


def step_summary(df: DataFrame, seconds: str, clipped: str) -> DataFrame:
    """``steps, median, p95, total, clipped_fraction`` of training steps; p95 at index ``int(0.95 (n - 1))``."""
    sums = df.agg(F.count(seconds).alias("steps"), F.sum(seconds).alias("total"), F.avg(F.col(clipped).cast("double")).alias("clipped_fraction"))
    ranked = values_at(df, seconds, {"_a": (0.5, F.floor), "_b": (0.5, F.ceil), "p95": (0.95, F.floor)})
    joined = sums.join(F.broadcast(ranked), F.lit(True), "left")  # one row each
    return joined.select("steps", ((F.col("_a") + F.col("_b")) / 2).alias("median"), "p95", "total", "clipped_fraction")


def peaks(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.agg(*(F.max(c).alias(c) for c in columns))


def status_counts(df: DataFrame, status: str, error: str) -> DataFrame:
    """Requests by status and error code, and ``total``, over which they sum."""
    from pyspark.sql import Window

    counted = df.groupBy(status, error).agg(F.count("*").alias("requests"))
    return counted.withColumn("total", F.sum("requests").over(Window.partitionBy(F.lit(0))))


def batching_tolerance(df: DataFrame, p_a: str, p_b: str, nll_a: str, nll_b: str, decision_a: str, decision_b: str, *, seconds_a: float, seconds_b: float) -> DataFrame:
    """Whether a batched run (b) may replace the plain one: differences, speed-up and ``passes`` by the fixed tolerances."""
    d = F.abs(F.col(p_a) - F.col(p_b))
    sums = df.agg(
        F.max(d).alias("max_dp"),
        F.count(d).alias("_n"),
        F.count_if(~F.col(decision_a).eqNullSafe(F.col(decision_b))).alias("decision_changes"),
        (F.avg(nll_b) - F.avg(nll_a)).alias("delta_nll"),
    )
    marks = {"p95_dp": 0.95, "median_dp": 0.5}
    ranked = values_at(df.select(d.alias("_d")), "_d", {f"{name}_{side}": (q, rounding) for name, q in marks.items() for side, rounding in (("low", F.floor), ("high", F.ceil))})

    def between(name: str, q: float) -> Column:
        """The linear quantile: between the values on both sides of its place."""
        place = F.lit(q) * (F.col("_n") - 1)
        return F.col(f"{name}_low") + (F.col(f"{name}_high") - F.col(f"{name}_low")) * (place - F.floor(place))

    joined = sums.join(F.broadcast(ranked), F.lit(True), "left")  # one row each
    out = joined.select("max_dp", *(between(name, q).alias(name) for name, q in marks.items()), "decision_changes", "delta_nll").withColumn("speed_up", F.lit(seconds_a / seconds_b))
    # Fixed tolerances: difference of probability, changed decisions, difference of NLL, speed-up.
    return out.withColumn("passes", (F.col("max_dp") <= 0.02) & (F.col("decision_changes") == 0) & (F.col("delta_nll") <= 0.005) & (F.col("speed_up") >= 1.5))
