import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.operators import resample


def test_bootstrap_equals_numpy(spark):
    groups, values = ["a", "a", "b", "b", "c"], [1.0, 1.0, 0.0, 0.0, 1.0]
    df = spark.createDataFrame(list(zip(groups, values)), "g string, v double").withColumn("one", F.lit(1.0))
    out = resample.bootstrap(df, "g", {"mean": ("v", "one")}, resample.numpy_draws(df, "g", 200, 1)).first()
    rng, means = np.random.default_rng(1), []
    by = {g: [v for h, v in zip(groups, values) if h == g] for g in "abc"}
    for _ in range(200):
        drawn = rng.choice(3, size=3, replace=True)
        means.append(np.mean(np.concatenate([by["abc"[i]] for i in drawn])))
    assert out.point == pytest.approx(0.6)
    assert [out.low, out.high] == pytest.approx([np.quantile(means, 0.025), np.quantile(means, 0.975)])
    assert out.defined_reps == 200


def test_undefined_repetitions_are_counted_out(spark):
    df = spark.createDataFrame([("a", 1.0, 1.0), ("b", 0.0, 0.0)], "g string, v double, n double")
    out = resample.bootstrap(df, "g", {"m": ("v", "n")}, resample.hashed_draws(df, "g", 100)).first()
    assert 0 < out.defined_reps < 100


def _predictions(spark, rows):
    return spark.createDataFrame(rows, "id string, group_id string, type string, target_index int, target_description string, nll double, correct boolean, input_sha256 string")


def test_compare_models(spark):
    a = _predictions(spark, [("1", "g", "binary", 0, "x", 1.0, False, "h"), ("2", "h", "choice", 1, "y", 0.5, True, "i")])
    b = a.withColumns({"nll": F.col("nll") - 0.25, "correct": F.lit(True)})
    rows = {r.metric: r.point for r in resample.compare_models(a, b, types=["binary", "choice"], reps=50).collect()}
    assert rows["b_minus_a.nll_all"] == pytest.approx(-0.25) and rows["b_minus_a.accuracy_all"] == pytest.approx(0.5)
    assert rows["b_minus_a.binary.accuracy"] == 1.0


@pytest.mark.parametrize("change", [{"id": "9"}, {"group_id": "z"}, {"type": "ordinal"}, {"target_index": 7}, {"input_sha256": "other"}])
def test_unpaired_predictions_fail(spark, change):
    a = _predictions(spark, [("1", "g", "binary", 0, "x", 1.0, False, "h")])
    with pytest.raises(ValueError, match="not paired"):
        resample.paired(a, a.withColumns({k: F.lit(v) for k, v in change.items()}))


def test_other_inputs_only_if_allowed(spark):
    a = _predictions(spark, [("1", "g", "binary", 0, "x", 1.0, False, "h")])
    b = a.withColumn("input_sha256", F.lit("other"))
    assert not resample.paired(a, b, allow_different_inputs=True).first().same_input


def test_triplets(spark):
    rows = [(t, r, c) for t, cs in (("a", (1, 1, 1)), ("b", (1, 0, 1))) for r, c in zip(("real", "other", "none"), cs)]
    df = spark.createDataFrame(rows, "t string, role string, ok int")
    r = resample.triplet_accuracy(df, "t", "role", "ok").first()
    assert (r.triplets, r.real, r.other, r["none"], r.all_correct) == (2, 1.0, 0.5, 1.0, 0.5)
    with pytest.raises(Exception, match="triplet"):
        resample.triplet_accuracy(df.where("role != 'none'"), "t", "role", "ok").collect()


def test_option_cue_and_information(spark):
    df = spark.createDataFrame([(["x", "y"], "x")] * 3 + [(["y", "z", "x"], "y")] * 3 + [(["z"], "z")], "o array<string>, l string").withColumn("s", F.array_join("o", ""))
    r = resample.option_cue(df, "o", "l").first()  # x and y are as frequent: the prior names y, the larger one, where both are present
    assert (r.n, r.signatures, r.prior_accuracy, r.mode_accuracy) == (7, 3, pytest.approx(4 / 7), 1.0)
    assert r.gain == pytest.approx(3 / 7)
    df = df.where("l != 'z'")
    assert resample.mutual_information(df, "s", "l").first().bits == pytest.approx(1.0)
    flat = df.withColumn("s", F.lit("s"))
    assert resample.mutual_information(flat, "s", "l").first().bits == pytest.approx(0.0)


def test_restricted_prior(spark):
    df = spark.createDataFrame([(["a", "b"], "a"), (["a", "b"], "a"), (["b", "c"], "c")], "o array<string>, l string")
    r = resample.restricted_prior_accuracy(df, "o", "l").first()
    assert (r.n, r.accuracy) == (3, 1.0)


def _triplet_rows(spark, hits):
    rows = [(t, role, bool(h)) for t, own in enumerate(hits) for role, h in zip(resample.ROLES, own)]
    return spark.createDataFrame(rows, "t long, role string, correct boolean")


def test_triplet_intervals_are_those_of_numpy(spark):
    rng = np.random.default_rng(8)
    a, b = rng.integers(0, 2, (40, 3)), rng.integers(0, 2, (40, 3))
    drawn = np.random.default_rng(3).integers(0, 40, size=(50, 40))
    found = {r.metric: r for r in resample.compare_triplets(_triplet_rows(spark, a), _triplet_rows(spark, b), "t", "role", "correct", reps=50, seed=3).collect()}
    for name, x, y in (("accuracy", a.mean(1), b.mean(1)), ("all_correct", a.min(1), b.min(1)), ("other", a[:, 1], b[:, 1])):
        spread = (y - x)[drawn].mean(1)
        assert np.allclose([found[name].a, found[name].b, found[name].low, found[name].high], [x.mean(), y.mean(), *np.quantile(spread, [0.025, 0.975])])
    single = {r.metric: r for r in resample.triplet_intervals(_triplet_rows(spark, a), "t", "role", "correct", reps=50, seed=3).collect()}
    assert np.allclose([single["accuracy"].low, single["accuracy"].high], np.quantile(a.mean(1)[drawn].mean(1), [0.025, 0.975]))


def test_triplets_of_one_side_fail(spark):
    a, b = _triplet_rows(spark, [[1, 1, 0]] * 3), _triplet_rows(spark, [[1, 1, 0]] * 2)
    with pytest.raises(Exception, match="one side only"):
        resample.compare_triplets(a, b, "t", "role", "correct", draws=resample.hashed_draws(a, "t", 4)).collect()


def test_model_set_needs_the_same_ids(spark):
    rows = [("a", 1, "g", "x", 0.5, True), ("a", 2, "h", "y", 0.7, False), ("b", 1, "g", "x", 0.4, True)]
    p = spark.createDataFrame(rows, "model string, id long, group_id string, type string, nll double, correct boolean")
    with pytest.raises(ValueError, match=r"\['b'\]"):
        resample.compare_model_set(p, "a", reps=5)
    with pytest.raises(ValueError):
        resample.compare_model_set(p, "none such", reps=5)
    found = {(r.model, r.type, r.metric): r for r in resample.compare_model_set(p.where("model = 'a'"), "a", reps=200).collect()}
    assert found["a", "all", "nll"].point == pytest.approx(0.6)
    assert found["a", "x", "nll"].defined_reps < 200 == found["a", "all", "nll"].defined_reps
    assert not any(metric.endswith("reference") for _, _, metric in found)


def test_any_aggregate_by_group(spark):
    rng = np.random.default_rng(1)
    group, x = rng.integers(0, 6, 80), rng.normal(size=80)
    df = spark.createDataFrame(list(zip(group.tolist(), x.tolist())), "g long, x double")
    draws = resample.numpy_draws(df, "g", 30, 5)
    found = resample.bootstrap_any(df, "g", {"deviation": F.stddev_pop("x")}, draws).first()
    gen, values = np.random.default_rng(5), []
    for _ in range(30):
        values.append(np.std(np.concatenate([x[group == g] for g in gen.choice(6, size=6, replace=True)])))
    assert np.allclose([found.point, found.low, found.high], [np.std(x), *np.quantile(values, [0.025, 0.975])])
