"""Executor-made draws against numpy's own."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.operators import draws, resample


@pytest.mark.parametrize(("n", "reps"), [(1, 7), (2, 30), (50, 40), (64, 20), (1000, 11), (50_000, 12)])
def test_counts_equal_numpys(spark, n, reps):
    rng = np.random.default_rng(9)
    told = {(r.rep, r["rank"]): r.times for r in draws.draw_counts(spark, draws.plan_draws(spark, n, reps, 9)).collect()}
    expected = {}
    for rep in range(reps):
        for rank, times in zip(*np.unique(rng.choice(n, size=n, replace=True), return_counts=True)):
            expected[rep, int(rank)] = int(times)
    assert told == expected


def test_any_place_of_the_stream(spark, monkeypatch):
    """Small blocks and a number of which many words are passed over, read from the middle."""
    monkeypatch.setattr(draws, "BLOCK_OUTPUTS", 37)
    monkeypatch.setattr(draws, "MOST_BLOCKS", 50)
    monkeypatch.setattr(draws, "CHUNK", 10)
    n = (1 << 31) + 12_345  # nearly half of the words are passed over
    plan = draws.plan_draws(spark, 1000, 1, 3)
    assert np.concatenate(list(plan.between(0, 1000))).tolist() == np.random.default_rng(3).integers(0, 1000, 1000).tolist()
    expected = np.random.default_rng(4).integers(0, n, 200)
    held = [sum(map(len, draws._taken(4, n, i * 37, 37))) for i in range(10)]
    plan = draws.Draws(4, n, 1, 37, np.cumsum(held) - np.array(held))
    for first, last in ((0, 200), (13, 14), (50, 180), (199, 200)):
        assert np.concatenate(list(plan.between(first, last))).tolist() == expected[first:last].tolist()


def test_both_ways_of_drawing_are_one_stream():
    a, b = np.random.default_rng(1), np.random.default_rng(1)
    assert np.concatenate([a.choice(77, size=77) for _ in range(5)]).tolist() == b.integers(0, 77, size=(5, 77)).ravel().tolist()


def test_ranks(spark):
    df = spark.createDataFrame([(x,) for x in ["b", "é", "a", None, "Z", "𐍈", "~"]], "g string").repartition(3)
    ranked, n = draws.sorted_ranks(df, "g")
    assert n == 7 and {r["g"]: r["_rank"] for r in ranked.collect()} == {g: i for i, g in enumerate([None, *sorted(["b", "é", "a", "Z", "𐍈", "~"])])}
    assert draws.sorted_ranks(df.limit(0), "g")[1] == 0


def _table(spark, n):
    return spark.range(n).select(F.format_string("g%05d", "id").alias("g"), (F.col("id") % 7 / 7.0).alias("v"), F.when(F.col("id") % 3 > 0, 1.0).alias("n"), F.when(F.col("id") % 2 == 0, "even").otherwise("odd").alias("side"))


def _by_hand(rows, reps, seed):
    rng, out = np.random.default_rng(seed), {}
    v, n = np.array([r.v for r in rows]), np.array([r.n or 0.0 for r in rows])
    for _ in range(reps):
        times = np.bincount(rng.choice(len(rows), size=len(rows)), minlength=len(rows))
        for side in ("even", "odd"):
            at = np.array([r.side == side for r in rows])
            if below := (times * n)[at].sum():
                out.setdefault(side, []).append((times * v)[at].sum() / below)
    return {k: (np.quantile(x, 0.025), np.quantile(x, 0.975), len(x)) for k, x in out.items()}


@pytest.mark.parametrize("cells", [8_000_000, 0])
def test_bootstrap_is_the_same_either_way(spark, monkeypatch, cells):
    monkeypatch.setattr(resample, "ARRAY_CELLS", cells)
    df = _table(spark, 60)
    told = resample.bootstrap(df, "g", {"m": ("v", "n")}, reps=80, seed=2, by=["side"]).collect()
    expected = _by_hand(df.orderBy("g").collect(), 80, 2)
    assert {r.side: (pytest.approx(r.low), pytest.approx(r.high), r.defined_reps) for r in told} == expected


def test_many_groups_take_the_same_draws(spark):
    n, reps = 50_000, 8
    df = _table(spark, n)
    told = {r.side: r for r in resample.bootstrap(df, "g", {"m": ("v", "n")}, reps=reps, seed=5, by=["side"]).collect()}
    for side, (low, high, defined) in _by_hand(df.orderBy("g").collect(), reps, 5).items():
        assert (told[side].low, told[side].high, told[side].defined_reps) == (pytest.approx(low), pytest.approx(high), defined)


def test_no_groups_one_group_and_a_null_one(spark):
    df = _table(spark, 3)
    assert resample.bootstrap(df.limit(0), "g", {"m": ("v", "n")}, reps=5).first().defined_reps == 0
    assert resample.bootstrap(df.where("g = 'g00001'"), "g", {"m": ("v", "n")}, reps=5).first().defined_reps == 5
    with_null = df.withColumn("g", F.when(F.col("g") != "g00000", F.col("g")))
    one = resample.bootstrap(with_null.withColumn("one", F.lit(1.0)), "g", {"m": ("v", "one")}, reps=40, seed=1).first()
    rng = np.random.default_rng(1)
    means = [np.array([0, 1 / 7, 2 / 7])[rng.choice(3, size=3)].mean() for _ in range(40)]
    assert (one.low, one.high) == (pytest.approx(np.quantile(means, 0.025)), pytest.approx(np.quantile(means, 0.975)))
    assert {r.g for r in resample.numpy_draws(with_null, "g", 9, 1).collect()} == {None, "g00001", "g00002"}
    with pytest.raises(ValueError, match="groups"):
        draws.plan_draws(spark, 1 << 32, 1, 0)
