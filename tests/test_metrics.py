"""Hand-computed metrics."""

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyloom.functions import prob
from tallyloom.operators import metrics


def _binary(spark, rows):
    return spark.createDataFrame([(float(z), y) for z, y in rows], "z double, y int")


def _logit(p):
    return math.log(p / (1 - p))


def test_binary_metrics_by_hand(spark):
    df = _binary(spark, [(_logit(p), y) for p, y in ((0.9, 1), (0.2, 0), (0.6, 0), (0.4, 1))])
    r = metrics.binary_metrics(df, "z", "y").first()
    assert (r.n, r.positives, r.precision, r.recall, r.f1, r.accuracy) == (4, 2, 0.5, 0.5, 0.5, 0.5)
    assert r.brier == pytest.approx(0.1925)


def test_extreme_logits_and_undefined_metrics(spark):
    assert metrics.binary_metrics(_binary(spark, [(80, 0)]), "z", "y").first().nll == pytest.approx(80)
    r = metrics.binary_metrics(_binary(spark, [(-5, 0), (-4, 0)]), "z", "y").first()
    assert (r.precision, r.recall, r.f1) == (None, None, None)
    wrong = metrics.binary_metrics(_binary(spark, [(5, 0), (-5, 1)]), "z", "y").first()
    assert (wrong.precision, wrong.recall, wrong.f1) == (0, 0, 0)


def test_bins_and_calibration(spark):
    p = spark.createDataFrame([(0.0,), (1.0,), (1 / 15,), (0.999999,)], "p double")
    assert [r[0] for r in p.select(prob.bin_index(F.col("p"))).collect()] == [0, 14, 1, 14]
    df = spark.createDataFrame([(0.7, 1), (0.7, 0)], "p double, y int")
    assert metrics.calibration_error(df, "p", "y").first().ece == pytest.approx(0.2)
    bins = metrics.reliability(df, "p", "y").collect()
    assert len(bins) == 15 and sum(b.n > 0 for b in bins) == 1


def _arrays(spark, rows):
    return spark.createDataFrame([([float(x) for x in p], t) for p, t in rows], "p array<double>, t int")


def test_choice_metrics_by_hand(spark):
    df = _arrays(spark, [([0.7, 0.2, 0.1], 0), ([0.5, 0.5], 1)])
    rows = {r.k: r for r in metrics.choice_metrics(df, "p", "t").collect()}
    assert rows[None].accuracy == 0.5 and rows[None].brier_sum == pytest.approx((0.14 + 0.5) / 2)
    assert set(rows) == {None, "2", "3"} and rows["2"].accuracy == 0  # a tie goes to the first
    brier = _arrays(spark, [([1, 0, 0], 0), ([0.2, 0.5, 0.3], 1)]).select(F.avg(prob.brier_sum(F.col("p"), F.col("t")))).first()[0]
    assert brier == pytest.approx(0.19)


def test_ordinal_metrics_by_hand(spark):
    r = {x.m: x for x in metrics.ordinal_metrics(_arrays(spark, [([0.2, 0.5, 0.3], 1)]), "p", "t").collect()}[None]
    assert (r.rps, r.mae, r.mae_norm) == (pytest.approx(0.065), pytest.approx(0.1), pytest.approx(0.05))
    assert metrics.cumulative_events(_arrays(spark, [([0.2, 0.5, 0.3], 1)]), "p", "t").count() == 2


def test_top_label_error_and_concentration(spark):
    df = _arrays(spark, [([0.9, 0.1], 0), ([0.9, 0.1], 1)])
    assert {r.k: r.ece for r in metrics.choice_metrics(df, "p", "t").collect()}[None] == pytest.approx(0.4)
    c = _arrays(spark, [([1, 0], 0), ([0.5, 0.5], 0)]).select(prob.concentration(F.col("p"))).collect()
    assert [x[0] for x in c] == [pytest.approx(1), pytest.approx(0)]


def test_bad_distribution_fails(spark):
    with pytest.raises(Exception, match="does not sum"):
        metrics.choice_metrics(_arrays(spark, [([0.7, 0.7], 0)]), "p", "t").collect()


def test_pairwise(spark):
    df = spark.createDataFrame([("g", 2.0, 1), ("g", 1.0, 0), ("h", 3.0, 1), ("h", 0.0, 0)], "g string, z double, y int")
    r = metrics.within_group_pairwise(df, "g", "z", "y").first()
    assert (r.pairs, r.pairwise_accuracy) == (2, 1.0)
    tied = metrics.within_group_pairwise(df.withColumn("z", F.lit(1.0)), "g", "z", "y").first()
    assert tied.pairwise_accuracy == 0.5
    none = metrics.within_group_pairwise(df.where("y = 1"), "g", "z", "y").first()
    assert (none.pairs, none.pairwise_accuracy) == (0, None)


def test_latency_uses_the_nearest_index(spark):
    values = [float(v) for v in range(1, 12)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    r = metrics.latency_summary(df, "v").first()
    pick = lambda q: sorted(values)[round(q * (len(values) - 1))]
    assert (r.n, r.p50, r.p95, r["max"]) == (11, pick(0.5), pick(0.95), 11)


def test_softmax_and_log_softmax(spark):
    z = [1.0, 3.0, -2.0, 700.0]
    row = spark.createDataFrame([(z,)], "z array<double>").select(prob.softmax(F.col("z"), 2.0), prob.log_softmax(F.col("z"))).first()
    e = np.exp((np.array(z) - max(z)) / 2)
    assert row[0] == pytest.approx(list(e / e.sum()))
    assert row[1] == pytest.approx([x - 700 for x in z])


def test_empty_table(spark):
    empty = spark.createDataFrame([], "z double, y int")
    assert metrics.binary_metrics(empty, "z", "y").count() == 0
    assert metrics.within_group_pairwise(empty.withColumn("g", F.lit("a")), "g", "z", "y").first().pairs == 0


def test_mean_nll_lists_all_types(spark):
    df = spark.createDataFrame([("binary", 1.0), ("binary", 3.0)], "type string, nll double")
    rows = {r.type: (r.n, r.nll) for r in metrics.mean_nll_by_type(df, ["binary", "choice", "ordinal"]).collect()}
    assert rows == {"all": (2, 2.0), "binary": (2, 2.0), "choice": (0, None), "ordinal": (0, None)}


def test_batching_tolerance(spark):
    df = spark.createDataFrame([(0.5, 0.51, 0.1, 0.1, "a", "a"), (0.2, 0.2, 0.3, 0.3, "b", "b")], "pa double, pb double, na double, nb double, da string, db string")
    r = metrics.batching_tolerance(df, "pa", "pb", "na", "nb", "da", "db", seconds_a=2, seconds_b=1).first()
    assert r.passes and r.decision_changes == 0 and r.max_dp == pytest.approx(0.01)


def test_step_summary(spark):
    df = spark.createDataFrame([(float(i), i % 2 == 0) for i in range(20)], "s double, c boolean")
    r = metrics.step_summary(df, "s", "c").first()
    assert (r.steps, r.p95, r.clipped_fraction) == (20, 18.0, 0.5)


@pytest.mark.parametrize("n", [1, 2, 3, 40, 4001, 30_000])
def test_values_at_places_of_a_sorted_list(spark, n):
    rng = np.random.default_rng(n)
    x = np.round(rng.pareto(1.2, n), 2)  # heavy tail, many ties
    df = spark.createDataFrame(pa.table({"x": x, "g": np.arange(n) % 2}))
    ranks = {"a": (0.0, F.floor), "b": (0.5, F.floor), "c": (0.5, F.ceil), "d": (0.95, F.floor), "e": (1.0, F.bround)}
    place = {"a": 0, "b": (n - 1) // 2, "c": n // 2, "d": int(0.95 * (n - 1)), "e": n - 1}
    assert metrics.values_at(df, "x", ranks).first().asDict() == {k: np.sort(x)[i] for k, i in place.items()}
    for row in metrics.values_at(df, "x", {"e": (0.5, F.floor)}, ["g"]).collect():
        own = np.sort(x[np.arange(n) % 2 == row.g])
        assert row.e == own[(len(own) - 1) // 2]


def test_values_at_nulls_and_no_rows(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("k", None)], "g string, x double")
    assert [tuple(r) for r in metrics.nearest_rank(df, "x", [1.0], ["g"]).collect()] == [(None, 3.0)]
    assert metrics.nearest_rank(df.limit(0), "x", [0.5]).count() == 0
    assert metrics.step_summary(df.limit(0).withColumn("c", F.lit(True)), "x", "c").first().steps == 0
