"""Heads trained over vectors: one step in closed form, a convex minimum, epochs, and runs that are stopped."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.operators import train
from tallyloom.operators.train import TrainParams, losses_and_pulls, mean_nll, train_heads
from tallyloom.schema import BINARY, CHOICE, ORDINAL
from tallyloom.sources.snapshots import Snapshots

SCHEMA = "id string, question_type string, vectors array<array<double>>, target_index int"


def questions(n, seed, dimensions=3):
    rng, rows = np.random.default_rng(seed), []
    for i in range(n):
        kind = (BINARY, CHOICE, ORDINAL)[i % 3]
        size = 1 if kind == BINARY else int(rng.integers(2, 5))
        x = rng.normal(size=(size, dimensions))
        score = x @ np.arange(1, dimensions + 1) + rng.logistic(size=size)
        rows.append((f"q{i:03d}", kind, x.tolist(), int(score[0] > 0) if kind == BINARY else int(score.argmax())))
    return rows


@pytest.mark.parametrize("kind", [BINARY, CHOICE, ORDINAL])
def test_derivatives(kind):
    rng = np.random.default_rng(1)
    z, t = rng.normal(size=(6, 1 if kind == BINARY else 4)), rng.integers(0, 2 if kind == BINARY else 4, 6)
    _, _, pull = losses_and_pulls(kind, z, t, 0.7)
    for i in range(z.shape[1]):
        up, down = (losses_and_pulls(kind, z + s * 1e-6 * np.eye(z.shape[1])[i], t, 0.7)[1] for s in (1, -1))
        assert pull[:, i] == pytest.approx((up - down) / 2e-6, abs=1e-6)


def plain_gradient(rows, w, weights, rps):
    """The step's gradient question by question."""
    slope = np.zeros_like(w)
    for _, kind, x, t in rows:
        head, x = train.TYPES.index(kind), np.array(x)
        _, _, pull = losses_and_pulls(kind, (x @ w[head, :-1] + w[head, -1])[None, :], np.array([t]), rps)
        slope[head, :-1] += weights[kind] * pull[0] @ x
        slope[head, -1] += weights[kind] * pull[0].sum()
    return slope / len(rows)


def test_steps_by_hand(spark, tmp_path):
    """Two epochs of several steps equal AdamW written out over the same order of questions."""
    rows = questions(25, 2)
    params = TrainParams(epochs=2, questions_per_step=8, learning_rate=0.05, weight_decay=0.1, rps_weight=0.3, type_weights={BINARY: 1.0, CHOICE: 0.5, ORDINAL: 2.0}, select_on="train", seed=4)
    done = train_heads(spark.createDataFrame(rows, SCHEMA).repartition(3), params, folder=str(tmp_path / "run"))
    import hashlib

    w, m, v, t = np.zeros((3, 4)), np.zeros((3, 4)), np.zeros((3, 4)), 0
    for epoch in (1, 2):
        order = sorted(rows, key=lambda r: hashlib.sha256(f"4:{epoch}:{r[0]}".encode()).hexdigest())
        for start in range(0, 25, 8):
            g, t = plain_gradient(order[start : start + 8], w, params.type_weights, 0.3), t + 1
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g**2
            w = w * (1 - 0.05 * 0.1) - 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    assert done.weights == pytest.approx(w, abs=1e-9) and done.epoch == 2
    assert [r.steps for r in done.history.orderBy("epoch").collect()] == [4, 4]


def test_a_convex_minimum(spark, tmp_path):
    """Binary questions with one feature of known odds: the head comes near the maximum of the likelihood."""
    rows = [(f"a{i}", BINARY, [[1.0]], int(i % 4 > 0)) for i in range(40)] + [(f"b{i}", BINARY, [[-1.0]], int(i % 5 == 0)) for i in range(40)]
    df = spark.createDataFrame(rows, SCHEMA)
    done = train_heads(df, TrainParams(epochs=18, questions_per_step=80, learning_rate=0.3, weight_decay=0.0), validation=df, folder=str(tmp_path))
    head = done.heads.first()
    assert head.bias + head.weights[0] == pytest.approx(np.log(3), abs=0.1)
    assert head.bias - head.weights[0] == pytest.approx(-np.log(4), abs=0.1)
    assert done.heads.count() == 1 and done.history.count() == 18
    told = [r.validation_nll_all for r in done.history.orderBy("epoch").collect()]
    assert told.index(min(told)) + 1 == done.epoch


@pytest.mark.parametrize("stops", [[1], [2, 3], [4, 1, 1]])
def test_a_stopped_run_goes_on_to_the_same_weights(spark, tmp_path, stops):
    df, held = spark.createDataFrame(questions(21, 5), SCHEMA), spark.createDataFrame(questions(9, 6), SCHEMA)
    params = TrainParams(epochs=2, questions_per_step=6, learning_rate=0.1, seed=1)
    whole = train_heads(df, params, validation=held, folder=str(tmp_path / "whole"))
    for i, after in enumerate(stops):
        assert train_heads(df, params, validation=held, folder=str(tmp_path / "parts"), resume=i > 0, stop_after=after) is None
    parts = train_heads(df, params, validation=held, folder=str(tmp_path / "parts"), resume=True)
    assert parts.weights.tolist() == whole.weights.tolist() and parts.epoch == whole.epoch
    assert sorted(map(str, parts.history.collect())) == sorted(map(str, whole.history.collect()))


def test_other_data_or_parameters_dont_go_on(spark, tmp_path):
    df, params = spark.createDataFrame(questions(9, 5), SCHEMA), TrainParams(epochs=1, questions_per_step=4, select_on="train")
    train_heads(df, params, folder=str(tmp_path), stop_after=1)
    with pytest.raises(ValueError, match="another run"):
        train_heads(df.limit(8), params, folder=str(tmp_path), resume=True)
    with pytest.raises(ValueError, match="another run"):
        train_heads(df, TrainParams(epochs=2, questions_per_step=4, select_on="train"), folder=str(tmp_path), resume=True)
    with pytest.raises(ValueError, match="no run"):
        train_heads(df, params, folder=str(tmp_path / "none"), resume=True)


def test_snapshots_survive_a_death_between_file_and_pointer(spark, tmp_path):
    kept = Snapshots(spark, str(tmp_path), "r")
    kept.note({})
    assert kept.latest() is None
    for i in range(4):
        kept.save({"i": i})
    put = kept._put
    kept._put = lambda name, text: put(name, text) if name != "LATEST" else (_ for _ in ()).throw(OSError("killed"))
    with pytest.raises(OSError, match="killed"):
        kept.save({"i": 4})
    again = Snapshots(spark, str(tmp_path), "r")
    assert again.latest() == {"i": 3} and again.save({"i": 5}) == 5 and again.latest() == {"i": 5}
    assert sorted(p.name for p in tmp_path.glob("snapshot*")) == ["snapshot-00000004.json", "snapshot-00000005.json"]
    (tmp_path / "snapshot-00000005.json").write_text("{}")
    (tmp_path / ".snapshot-00000005.json.crc").unlink(missing_ok=True)
    with pytest.raises(ValueError, match="damaged"):
        again.latest()


@pytest.mark.parametrize(
    ("row", "what"),
    [
        (("x", BINARY, [[1.0, 2.0, 3.0], [1.0, 2.0, 3.0]], 0), "numbers of candidates"),
        (("x", CHOICE, [[1.0, 2.0, 3.0]] * 2, 2), "out of range"),
        (("x", CHOICE, [[1.0, 2.0, 3.0]] * 2, None), "out of range"),
        (("x", "other", [[1.0, 2.0, 3.0]] * 2, 1), "unknown types"),
        (("x", CHOICE, [[1.0, 2.0, 3.0], [1.0]], 1), "vectors"),
        (("x", CHOICE, [[1.0, 2.0, float("nan")], [1.0, 2.0, 3.0]], 1), "vectors"),
        (("x", CHOICE, None, 1), "candidates"),
        ((None, BINARY, [[1.0, 2.0, 3.0]], 1), "null"),
    ],
)
def test_malformed_questions(spark, tmp_path, row, what):
    df = spark.createDataFrame([*questions(3, 1), row], SCHEMA)
    with pytest.raises(ValueError, match=what):
        train_heads(df, TrainParams(select_on="train"), folder=str(tmp_path))


def test_no_questions_and_no_validation(spark, tmp_path):
    df = spark.createDataFrame(questions(3, 1), SCHEMA)
    with pytest.raises(ValueError, match="no questions"):
        train_heads(df.limit(0), TrainParams(select_on="train"), folder=str(tmp_path))
    with pytest.raises(ValueError, match="validation"):
        train_heads(df, TrainParams(), folder=str(tmp_path))
    with pytest.raises(ValueError, match="not trainable"):
        TrainParams(epochs=0)
    assert mean_nll(df.limit(0), np.zeros((3, 4))) == {"all": None, BINARY: None, CHOICE: None, ORDINAL: None}


def test_binary_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0], 1)], "i int, v array<float>, y int")
    row = train.binary_questions(df, "i", "v", "y").withColumn("extra", F.lit(1)).first()
    assert (row.id, row.vectors, row.target_index) == ("1", [[1.0, 2.0]], 1)
