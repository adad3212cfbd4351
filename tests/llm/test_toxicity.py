"""Toxicity: gradients against differences, windows and features against loops, and accuracy on rows held out."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyloom.llm import toxicity as tox
from tallyloom.llm.queries import op8_toxicity

MIDDLE = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tiny():
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(60)]
    texts, labels = [], []
    for i in range(120):
        own = list(rng.choice(words, rng.integers(5, 150)))
        if i % 2:
            own[int(rng.integers(len(own)))] = "vileword"
        texts.append(" ".join(own))
        labels.append(i % 2)
    return tox.train(texts, labels)


def test_windows_cover_every_word():
    for count in (0, 1, tox.WINDOW, tox.WINDOW + 1, 1000):
        starts = tox.window_starts(count)
        seen = np.zeros(count, dtype=bool)
        for s in starts:
            assert s >= 0
            seen[s : s + tox.WINDOW] = True
        assert seen.all()
        if count > tox.WINDOW:
            assert starts[-1] == count - tox.WINDOW and (np.diff(starts) <= tox.STRIDE).all()


def test_gradients_against_differences(tiny):
    rng = np.random.default_rng(2)
    model = tox.Model(tiny.vocabulary, {k: v.astype(np.float64) for k, v in tiny.weights.items()})
    words = [b"w1", b"w2", b"vileword", b"x"]
    own = np.array([tiny.vocabulary.get(w, 0) for w in words])
    chars = tox.grams(words)
    batch, mask, target = np.array([[0, 1, 2, 3], [2, 1, 0, 0]]), np.array([[1, 1, 1, 1], [1, 1, 0, 0.0]]), np.array([1.0, 0.0])
    loss = lambda: tox._gradients(model, batch, mask, chars, own, target)
    _, g = loss()
    for name, weights in model.weights.items():
        places = np.flatnonzero(np.abs(g[name].ravel()) > 1e-9)
        for at in rng.choice(places, min(4, len(places)), replace=False):
            flat, step = weights.ravel(), 1e-4
            before = flat[at]
            flat[at] = before + step
            up = loss()[0]
            flat[at] = before - step
            down = loss()[0]
            flat[at] = before
            assert g[name].ravel()[at] == pytest.approx((up - down) / (2 * step), rel=0.02, abs=2e-4), name


def test_windows_have_the_logits_of_single_ones(tiny):
    words = [b"w1", b"w2", b"vileword"]
    inputs = tiny.inputs(words)
    long = np.array([0, 1, 2, 0, 1] + [-1] * 91)
    short = np.array([2] + [-1] * 95)
    both = tiny.logits(inputs, np.stack([long, short]))
    assert both[0] == pytest.approx(tiny.logits(inputs, long[None])[0], abs=1e-4)
    assert both[1] == pytest.approx(tiny.logits(inputs, short[None])[0], abs=1e-4)


def test_one_word_anywhere_in_a_long_text(tiny):
    plain = [f"w{i % 60}" for i in range(3000)]
    for at in (0, 1500, 2999):
        toxic = list(plain)
        toxic[at] = "vileword"
        clean_score, toxic_score = tox.score_texts(tiny, pa.array([" ".join(plain), " ".join(toxic)]))
        assert toxic_score > clean_score


def test_features_against_loops():
    logits, owner = np.array([0.5, -1.0, 2.0, 3.0], dtype=np.float32), np.array([0, 0, 1, 0])
    found = tox.document_features(logits, owner, 2)
    p = 1 / (1 + np.exp(-logits[[0, 1, 3]]))
    mean = p.mean()
    assert found[0] == pytest.approx([3.0, np.log(mean / (1 - mean)), np.log(3), 1], abs=1e-5)


def test_accuracy_on_rows_held_out(spark):
    """Labels of held-out rows are never learnt; most of them are predicted right, at the query's threshold."""
    scored = op8_toxicity(spark, MIDDLE)
    assert scored.count() == spark.read.parquet(f"{MIDDLE}/documents.parquet").count()
    rows = scored.where("held_out").join(spark.read.parquet(f"{MIDDLE}/labels.parquet"), "doc_id").toPandas()
    assert all(tox.held_out(i) for i in rows["doc_id"])
    right = (rows["predicted"] == rows["toxic"]).mean()
    toxic, clean = rows[rows["toxic"] == 1]["score"].to_numpy(), rows[rows["toxic"] == 0]["score"].to_numpy()
    auc = ((toxic[:, None] > clean[None]).mean() + (toxic[:, None] == clean[None]).mean() / 2) if len(toxic) and len(clean) else 1
    assert right >= 0.9 and auc >= 0.85, (right, auc, len(rows))
    assert rows["score"].between(0, 1).all() and ((rows["score"] >= 0.7).astype(int) == rows["predicted"]).all()


def test_held_out_labels_do_not_matter(spark):
    documents, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    wrong = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    scores = [tox.score_documents(documents, tox.fit(documents, rows)).orderBy("doc_id").toPandas() for rows in (labels, wrong, labels)]
    assert scores[0].equals(scores[1]) and scores[0].equals(scores[2])


def test_awkward_rows_and_empty_tables(spark, awkward, nothing):
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, None), (None, 1), (5, 0), (8, 0)], "doc_id long, toxic int")
    out = tox.score_documents(awkward, tox.fit(awkward, labels)).toPandas()
    assert len(out) == 12 and out["score"].between(0, 1).all()
    untrained = tox.fit(nothing, labels.limit(0))
    assert tox.score_documents(awkward, untrained).toPandas()["score"].between(0, 1).all()
    assert tox.score_documents(nothing, untrained).count() == 0
    kept = tox.score_documents(awkward, untrained, keep=["doc_id", "text", "source"])
    assert kept.columns == ["doc_id", "text", "source", "score"]
