"""Group bootstrap, paired comparison, triplets and option cues."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import prob
from tallyloom.operators.draws import draw_counts, plan_draws, sorted_ranks, weighted_sums
from tallyloom.operators.split import hash_ranks

#: Groups times summed columns up to which a bootstrap sends groups' sums to the tasks that make repetitions.
ARRAY_CELLS = 8_000_000


def numpy_draws(df: DataFrame, group: str, reps: int, seed: int) -> DataFrame:
    """``(rep, group, times)``: draws of ``numpy.random.default_rng(seed)`` over the sorted groups, made by the executors.

    ``choice`` once a repetition and ``integers`` for all of them at once are the same draws. A null group comes first.
    """
    ranked, n = sorted_ranks(df.select(group).distinct(), group)
    if not n:
        return ranked.select(F.lit(0).cast("long").alias("rep"), group, F.lit(0).cast("long").alias("times")).limit(0)
    return draw_counts(df.sparkSession, plan_draws(df.sparkSession, n, reps, seed)).join(ranked, F.col("rank") == F.col("_rank")).select("rep", group, "times")


def hashed_draws(df: DataFrame, group: str, reps: int) -> DataFrame:
    """``(rep, group, times)`` by ``md5(rep:slot) mod n`` over the groups in hash order; made by the executors."""
    spark = df.sparkSession
    ranked, n = hash_ranks(df.select(group).distinct(), F.sha2(F.col(group).cast("string"), 256))
    slots = spark.range(reps * n).select((F.col("id") / max(1, n)).cast("long").alias("rep"), (F.col("id") % max(1, n)).alias("slot"))
    picked = F.conv(F.substring(F.md5(F.concat_ws(":", "rep", "slot")), 1, 8), 16, 10).cast("long") % max(1, n)
    times = slots.select("rep", picked.alias("_rank")).groupBy("rep", "_rank").agg(F.count("*").alias("times"))
    return times.join(ranked, "_rank").drop("_rank")


def _intervals(values: DataFrame, keys: Sequence[str], level: float) -> DataFrame:
    """``low, high, defined_reps`` of ``value`` by ``keys``; undefined repetitions are counted out."""
    alpha = (1 - level) / 2
    found = values.where("value IS NOT NULL").groupBy(*keys).agg(F.percentile("value", F.array(F.lit(alpha), F.lit(1 - alpha))).alias("_i"), F.count("*").alias("defined_reps"))
    return found.select(*keys, F.col("_i")[0].alias("low"), F.col("_i")[1].alias("high"), "defined_reps")


def _resampled_sums(per_group: DataFrame, group: str, by: Sequence[str], parts: Sequence[str], reps: int, seed: int) -> DataFrame:
    """``rep, *by, *parts``: sums over the groups that numpy's draws take.

    Up to ``ARRAY_CELLS`` the groups' sums go to the tasks, each of which makes whole repetitions, so that draws aren't
    shuffled. Beyond, the draws are joined to the groups.
    """
    spark = per_group.sparkSession
    ranked, n = sorted_ranks(per_group.select(group).distinct(), group)
    rows = per_group.join(ranked.withColumnRenamed(group, "_group"), F.col(group).eqNullSafe(F.col("_group"))).select("_rank", *by, *parts)
    if not n:
        return rows.withColumnRenamed("_rank", "rep").limit(0)
    draws = plan_draws(spark, n, reps, seed)
    if rows.count() * len(parts) > ARRAY_CELLS:
        drawn = draw_counts(spark, draws).join(rows, F.col("rank") == F.col("_rank"))
        return drawn.groupBy("rep", *by).agg(*(F.sum(F.col(c) * F.col("times")).alias(c) for c in parts))
    table = rows.toArrow()
    named = list(zip(*(table.column(c).to_pylist() for c in by))) if by else [()] * table.num_rows
    keys = {k: i for i, k in enumerate(dict.fromkeys(named))}
    values = np.stack([table.column(c).to_numpy(zero_copy_only=False).astype(np.float64) for c in parts], axis=1)
    sums = weighted_sums(spark, draws, table.column("_rank").to_numpy(), np.array([keys[k] for k in named], dtype=np.int64), values, len(keys))
    kinds = ", ".join(["_key long", *(f"`{c}` {per_group.schema[c].dataType.simpleString()}" for c in by)])
    told = F.broadcast(spark.createDataFrame([(i, *k) for k, i in keys.items()], kinds))  # one row for each value of ``by``
    return sums.join(told, F.col("key") == F.col("_key")).select("rep", *by, *(F.col("sums")[i].alias(c) for i, c in enumerate(parts)))


def bootstrap(df: DataFrame, group: str, sums: dict[str, tuple[str, str]], draws: DataFrame | None = None, *, reps: int = 1000, seed: int = 0, level: float = 0.95, by: Sequence[str] = ()) -> DataFrame:
    """``*by, metric, point, low, high, defined_reps`` of ratios of sums, by resampling whole groups.

    ``sums`` gives each metric's numerator and denominator columns. Groups are summed once, repetitions are weighted sums
    of them, for each value of ``by`` (never null). A repetition whose denominator is 0, or that draws no group with a
    value of ``by``, leaves the metric undefined and is dropped and counted out. Without ``draws``, ``reps`` repetitions
    are numpy's for ``seed``, whatever the number of groups.
    """
    parts = sorted({c for pair in sums.values() for c in pair})
    per_group = df.groupBy(group, *by).agg(*(F.sum(F.col(c).cast("double")).alias(c) for c in parts))
    if draws is None:
        weighted = _resampled_sums(per_group, group, by, parts, reps, seed)
    else:
        weighted = draws.join(per_group, group).groupBy("rep", *by).agg(*(F.sum(F.col(c) * F.col("times")).alias(c) for c in parts))
    metrics = F.array(*[F.struct(F.lit(m).alias("metric"), prob.safe_div(F.col(a), F.col(b)).alias("value")) for m, (a, b) in sums.items()])
    named = lambda frame: frame.select(*by, F.explode(metrics).alias("m")).select(*by, "m.metric", "m.value")
    point = named(per_group.groupBy(*by).agg(*(F.sum(c).alias(c) for c in parts))).withColumnRenamed("value", "point")
    keys = [*by, "metric"]
    return point.join(_intervals(named(weighted), keys, level), keys, "left").fillna(0, ["defined_reps"])


def bootstrap_any(df: DataFrame, group: str, aggregates: dict[str, Column], draws: DataFrame, *, level: float = 0.95) -> DataFrame:
    """``metric, point, low, high, defined_reps`` of any aggregate of rows, by resampling whole groups.

    A group's rows stand as often as it is drawn, so this handles as many rows as there are in all repetitions together,
    aggregated where they arise; metrics that are ratios of sums are cheaper by ``bootstrap``.
    """
    made = [a.cast("double").alias(m) for m, a in aggregates.items()]
    long = lambda frame: frame.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in aggregates])).alias("m")).select("m.metric", "m.value")
    repeated = df.join(draws, group).withColumn("_turn", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
    point = long(df.agg(*made)).withColumnRenamed("value", "point")
    return point.join(_intervals(long(repeated.groupBy("rep").agg(*made)), ["metric"], level), "metric", "left").fillna(0, ["defined_reps"])


def paired(a: DataFrame, b: DataFrame, *, allow_different_inputs: bool = False) -> DataFrame:
    """Predictions of two models joined by id: ``id, group_id, type, nll_a, nll_b, d_nll, d_correct, same_input``.

    Both must hold the same ids, once each, with equal group, type, label and (unless allowed) input hash; otherwise a
    ``ValueError`` tells how many rows differ in what. With different inputs and numbers of candidates only the
    label's description must agree.
    """
    joined = a.alias("a").join(b.alias("b"), F.col("a.id") == F.col("b.id"), "full_outer")
    col = lambda side, c: F.col(f"{side}.{c}") if c in (a if side == "a" else b).columns else F.lit(None)
    differ = lambda c: ~col("a", c).eqNullSafe(col("b", c))
    wider = F.lit(False)
    if allow_different_inputs and "row_logits" in a.columns and "row_logits" in b.columns:
        wider = ~F.size("a.row_logits").eqNullSafe(F.size("b.row_logits"))
    one_sided = F.col("a.id").isNull() | F.col("b.id").isNull()
    checks = {
        "ids that only one has": one_sided,
        "group": ~one_sided & differ("group_id"),
        "type": ~one_sided & differ("type"),
        "label": ~one_sided & ((~wider & differ("target_index")) | differ("target_description") | (wider & col("a", "target_description").isNull())),
        "input": ~one_sided & (F.lit(False) if allow_different_inputs else differ("input_sha256")),
        "input given by one only": ~one_sided & (col("a", "input_sha256").isNull() != col("b", "input_sha256").isNull()),
    }
    found = joined.agg(*(F.count_if(c).alias(n) for n, c in checks.items())).first().asDict()
    for side, df in (("a", a), ("b", b)):
        found[f"ids that {side} repeats"] = df.groupBy("id").count().where("count > 1").count()
    if wrong := {k: v for k, v in found.items() if v}:
        raise ValueError(f"predictions are not paired: {wrong}")
    return a.alias("a").join(b.alias("b"), F.col("a.id") == F.col("b.id")).select(
        "a.id",
        "a.group_id",
        "a.type",
        F.col("a.nll").alias("nll_a"),
        F.col("b.nll").alias("nll_b"),
        (F.col("b.nll") - F.col("a.nll")).alias("d_nll"),
        (F.col("b.correct").cast("double") - F.col("a.correct").cast("double")).alias("d_correct"),
        col("a", "input_sha256").eqNullSafe(col("b", "input_sha256")).alias("same_input"),
    )


def compare_models(a: DataFrame, b: DataFrame, *, types: Sequence[str], reps: int = 1000, seed: int = 0, level: float = 0.95, allow_different_inputs: bool = False, draws: DataFrame | None = None) -> DataFrame:
    """Paired differences b - a of NLL and accuracy, overall and by type, with group-bootstrap intervals (by ``draws``, if given)."""
    rows = paired(a, b, allow_different_inputs=allow_different_inputs).withColumn("one", F.lit(1.0))
    sums = {"a.nll_all": ("nll_a", "one"), "b.nll_all": ("nll_b", "one"), "b_minus_a.nll_all": ("d_nll", "one"), "b_minus_a.accuracy_all": ("d_correct", "one")}
    for i, t in enumerate(types):
        here = F.when(F.col("type") == t, 1.0).otherwise(0.0)
        rows = rows.withColumns({f"one_{i}": here, f"nll_{i}": here * F.col("d_nll"), f"correct_{i}": here * F.col("d_correct")})
        sums |= {f"b_minus_a.{t}.nll": (f"nll_{i}", f"one_{i}"), f"b_minus_a.{t}.accuracy": (f"correct_{i}", f"one_{i}")}
    return bootstrap(rows, "group_id", sums, draws, reps=reps, seed=seed, level=level)


def compare_model_set(predictions: DataFrame, reference: str, *, reps: int = 1000, seed: int = 0, level: float = 0.95, draws: DataFrame | None = None) -> DataFrame:
    """``model, type, metric, point, low, high, defined_reps`` of several models over the same questions.

    ``predictions`` holds ``model, id, group_id, type, nll, correct``; ``type`` is also ``all``. Metrics are ``nll`` and
    ``accuracy``, and but for the model ``reference`` both less its own on the same rows. Every model must have the
    reference's ids once each, else a ``ValueError`` names it.
    """
    own = predictions.where(F.col("model") == reference).select("id", F.col("nll").alias("_nll"), F.col("correct").alias("_correct"))
    joined = predictions.join(own, "id", "left")
    counts = joined.groupBy("model").agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids"), F.count_if(F.col("_correct").isNull()).alias("lost"))
    seen = {r["model"]: (r["n"], r["ids"], r["lost"]) for r in counts.collect()}  # one row a model
    size = seen.get(reference, (0, 0, 0))[0]
    if wrong := sorted(m for m, found in seen.items() if found != (size, size, 0)) or ([] if size else [reference]):
        raise ValueError(f"models without the reference's ids, once each: {wrong}")
    correct = F.col("correct").cast("double")
    rows = joined.select(
        "model", "group_id", F.explode(F.array(F.col("type"), F.lit("all"))).alias("type"), "nll", correct.alias("correct"),
        (F.col("nll") - F.col("_nll")).alias("d_nll"), (correct - F.col("_correct").cast("double")).alias("d_correct"), F.lit(1.0).alias("one"),
    )
    sums = {"nll": ("nll", "one"), "accuracy": ("correct", "one"), "nll_minus_reference": ("d_nll", "one"), "accuracy_minus_reference": ("d_correct", "one")}
    found = bootstrap(rows, "group_id", sums, draws, reps=reps, seed=seed, level=level, by=["model", "type"])
    return found.where((F.col("model") != reference) | ~F.col("metric").endswith("_minus_reference"))


ROLES = ("real", "other", "none")


#: What two models' predictions of one role must agree in, if they tell it.
PAIRING = ("group_id", "input_sha256", "target_index")


def _whole_triplets(df: DataFrame, triplet: str, role: str, correct: str, roles: Sequence[str], pairing: Sequence[str] = ()) -> DataFrame:
    """One row per triplet with 0 or 1 for each role and ``accuracy, all_correct``; a repeated, unknown or missing role fails.

    With ``pairing``, also ``pairing``: those columns of each role, in the order of roles.
    """
    hits = [F.max(F.when(F.col(role) == r, F.col(correct).cast("int"))).alias(r) for r in roles]
    said = [F.array_sort(F.collect_list(F.struct(F.col(role), *pairing))).alias("pairing")] if pairing else []  # a row a role
    grouped = df.groupBy(triplet).agg(*hits, *said, F.count("*").alias("_rows"), F.count_if(F.col(role).isin(*roles)).alias("_known"))
    fine = (F.col("_rows") == len(roles)) & (F.col("_known") == len(roles))
    for r in roles:
        fine = fine & F.col(r).isNotNull()
    checked = grouped.select(triplet, *(F.when(fine, F.col(r)).otherwise(F.raise_error(F.lit("a triplet has repeated, unknown or missing roles"))).cast("double").alias(r) for r in roles), *(["pairing"] if pairing else []))
    held = F.array(*roles)
    return checked.withColumns({"accuracy": prob.total(held) / len(roles), "all_correct": F.array_min(held)})


def triplet_accuracy(df: DataFrame, triplet: str, role: str, correct: str, roles: Sequence[str] = ROLES) -> DataFrame:
    """``triplets``, accuracy by role and ``all_correct``; a repeated, unknown or missing role fails the query."""
    return _whole_triplets(df, triplet, role, correct, roles).agg(F.count("*").alias("triplets"), *(F.avg(r).alias(r) for r in (*roles, "all_correct")))


def triplet_intervals(df: DataFrame, triplet: str, role: str, correct: str, roles: Sequence[str] = ROLES, *, reps: int = 1000, seed: int = 0, level: float = 0.95, draws: DataFrame | None = None) -> DataFrame:
    """``metric, point, low, high, defined_reps`` of ``accuracy``, ``all_correct`` and each role, by resampling triplets."""
    rows = _whole_triplets(df, triplet, role, correct, roles).withColumn("one", F.lit(1.0))
    sums = {m: (m, "one") for m in ("accuracy", "all_correct", *roles)}
    return bootstrap(rows, triplet, sums, draws, reps=reps, seed=seed, level=level)


def compare_triplets(a: DataFrame, b: DataFrame, triplet: str, role: str, correct: str, roles: Sequence[str] = ROLES, *, reps: int = 1000, seed: int = 0, level: float = 0.95, draws: DataFrame | None = None) -> DataFrame:
    """``metric, a, b, b_minus_a, low, high, defined_reps`` of two models on the same triplets, paired by triplet.

    The interval is that of the difference. Triplets that only one side has fail the query, and so do roles whose group,
    input hash or target (``PAIRING``) differ between the sides; a column of these that one side alone has is a ``ValueError``.
    """
    metrics = ("accuracy", "all_correct", *roles)
    pairing = [c for c in PAIRING if c in a.columns or c in b.columns]
    if lacking := [c for c in pairing if c not in a.columns or c not in b.columns]:
        raise ValueError(f"only one side tells {lacking}")
    sides = [_whole_triplets(df, triplet, role, correct, roles, pairing).select(F.col(triplet).alias(f"_{side}"), *(F.col(m).alias(f"{side}_{m}") for m in metrics), *([F.col("pairing").alias(f"{side}_pairing")] if pairing else [])) for side, df in (("a", a), ("b", b))]
    joined = sides[0].join(sides[1], F.col("_a") == F.col("_b"), "full_outer")
    both = F.when(F.col("_a").isNull() | F.col("_b").isNull(), F.raise_error(F.lit("a triplet is on one side only")))
    if pairing:
        both = both.when(~F.col("a_pairing").eqNullSafe(F.col("b_pairing")), F.raise_error(F.lit("a triplet's groups, inputs or targets differ between the sides")))
    both = both.otherwise(F.col("_a"))
    rows = joined.withColumn(triplet, both).withColumns({"one": F.lit(1.0), **{f"d_{m}": F.col(f"b_{m}") - F.col(f"a_{m}") for m in metrics}})
    means = rows.agg(F.array(*[F.struct(F.lit(m).alias("metric"), F.avg(f"a_{m}").alias("a"), F.avg(f"b_{m}").alias("b")) for m in metrics]).alias("m")).select(F.explode("m").alias("m")).select("m.*")
    spread = bootstrap(rows, triplet, {m: (f"d_{m}", "one") for m in metrics}, draws, reps=reps, seed=seed, level=level)
    return means.join(spread.withColumnRenamed("point", "b_minus_a"), "metric")


def option_cue(df: DataFrame, options: str, label: str) -> DataFrame:
    """How well the set of an example's options alone predicts its label: ``n, signatures, prior_accuracy, mode_accuracy, gain``.

    The prior names, of the options present, the label most frequent over all rows (ties: the largest label); the mode
    is the most frequent label among the rows of the same options. ``gain`` is what the mode has over the prior.
    """
    cells = df.select(F.array_sort(F.array_distinct(F.col(options))).alias("_s"), F.col(label).alias("_l")).groupBy("_s", "_l").agg(F.count("*").alias("n"))
    overall = cells.groupBy("_l").agg(F.sum("n").alias("_f"))
    present = cells.select("_s").distinct().select("_s", F.explode("_s").alias("_l")).join(overall, "_l", "left")
    named = present.groupBy("_s").agg(F.max_by("_l", F.struct(F.coalesce("_f", F.lit(0)), F.col("_l"))).alias("_guess"))
    hit = F.coalesce(F.sum(F.when(F.col("_l") == F.col("_guess"), F.col("n"))), F.lit(0)).alias("prior")
    by_signature = cells.join(named, "_s", "left").groupBy("_s").agg(F.sum("n").alias("n"), F.max("n").alias("mode"), hit)
    n, prior, mode = F.sum("n"), F.sum("prior"), F.sum("mode")
    return by_signature.agg(
        n.alias("n"),
        F.count("*").alias("signatures"),
        prob.safe_div(prior, n).alias("prior_accuracy"),
        prob.safe_div(mode, n).alias("mode_accuracy"),
        prob.safe_div(mode - prior, n).alias("gain"),
    )


def restricted_prior_accuracy(df: DataFrame, options: str, label: str) -> DataFrame:
    """Accuracy of always naming, of the options present, the label most frequent overall (ties: the largest label)."""
    return option_cue(df, options, label).select("n", F.col("prior_accuracy").alias("accuracy"))


def mutual_information(df: DataFrame, a: str, b: str) -> DataFrame:
    """Plug-in mutual information of two columns in bits: ``n, bits``."""
    from pyspark.sql import Window

    cells = df.groupBy(a, b).agg(F.count("*").alias("c"))
    sums = cells.withColumns({"ca": F.sum("c").over(Window.partitionBy(a)), "cb": F.sum("c").over(Window.partitionBy(b))})
    n = cells.agg(F.sum("c").alias("n"))
    rows = sums.withColumn("_k", F.lit(0)).join(F.broadcast(n.withColumn("_k", F.lit(0))), "_k")  # one row of the total
    term = F.col("c") / F.col("n") * F.log2(F.col("c") * F.col("n") / (F.col("ca") * F.col("cb")))
    return rows.agg(F.first("n").alias("n"), F.sum(term).alias("bits"))
