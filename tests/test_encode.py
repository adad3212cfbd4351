"""Encoding in length-sorted batches: the same vectors in any batches, partitions and cache; counters that add up."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.operators import encode
from tallyloom.operators.encode import counters, encode_missing, encode_rows, last_states, recurrent_states, word_ids

MODEL = recurrent_states(3)


@pytest.fixture(scope="module")
def rows(spark):
    texts = [" ".join(f"w{i * j % 17}" for j in range(1 + i * 7 % 23)) for i in range(60)]
    return spark.createDataFrame([(f"h{i:02d}", t) for i, t in enumerate(texts)], "row_sha256 string, text string").cache()


def alone(rows):
    """Every row's vector by itself, without padding."""
    told = {}
    for r in rows.withColumn("ids", word_ids("text", 50)).collect():
        ids = np.array([r.ids])
        told[r.row_sha256] = MODEL(ids, np.ones(ids.shape, dtype=bool))[0, -1]
    return told


@pytest.mark.parametrize(("batch_rows", "parts"), [(1, 2), (8, 1), (8, 5), (100, 3)])
def test_vectors_dont_depend_on_batches(spark, rows, batch_rows, parts):
    found, counted = encode_rows(rows.repartition(parts), word_ids("text", 50), MODEL, max_tokens=30, batch_rows=batch_rows)
    told, expected = {r.row_sha256: r.features for r in found.collect()}, alone(rows)
    assert told.keys() == expected.keys() and all(told[k] == pytest.approx(expected[k], abs=1e-6) for k in told)
    sizes = sorted((len(t.split()) for (t,) in rows.select("text").collect()), reverse=True)
    batches = [sizes[i : i + batch_rows] for i in range(0, len(sizes), batch_rows)]
    assert counted.first().asDict() == {"rows": 60, "longest": sizes[0], "forwards": len(batches), "valid_tokens": sum(sizes), "padding_tokens": sum(b[0] - n for b in batches for n in b)}


def test_only_misses_are_encoded(spark, rows, tmp_path):
    ids = word_ids("text", 50)
    _, first = encode_missing(rows.limit(20), ids, MODEL, str(tmp_path / "cache"), "f", max_tokens=30)
    found, second = encode_missing(rows, ids, MODEL, str(tmp_path / "cache"), "f", max_tokens=30)
    assert (first.first()["rows"], second.first()["rows"]) == (20, 40)
    told, expected = {r.row_sha256: r.features for r in found.collect()}, alone(rows)
    assert all(told[k] == pytest.approx(v, abs=1e-6) for k, v in expected.items()) and len(told) == 60
    assert encode_missing(rows, ids, MODEL, str(tmp_path / "cache"), "f", max_tokens=30)[1].first().asDict() == {"rows": 0, "longest": None, "forwards": 0, "valid_tokens": 0, "padding_tokens": 0}


def test_no_text_is_cut(spark, rows):
    ids = word_ids("text", 50)
    with pytest.raises(ValueError, match="more than 5 tokens, 0 have none"):
        encode_rows(rows, ids, MODEL, max_tokens=5)
    blank = rows.limit(1).withColumn("text", F.lit(" \n"))
    with pytest.raises(ValueError, match="0 rows have more than 30 tokens, 1 have none"):
        encode_rows(blank, ids, MODEL, max_tokens=30)
    found, counted = encode_rows(rows.limit(0), ids, MODEL, max_tokens=5)
    assert found.count() == 0 and counted.first()["forwards"] == 0


def test_the_last_state_under_a_mask():
    states = np.arange(24).reshape(2, 4, 3)
    mask = np.array([[1, 1, 0, 0], [1, 0, 1, 0]], dtype=bool)
    assert last_states(states, mask).tolist() == [states[0, 1].tolist(), states[1, 2].tolist()]
    with pytest.raises(ValueError, match="no tokens"):
        last_states(states, np.zeros((2, 4), dtype=bool))


def test_a_vector_that_isnt_finite(spark, rows):
    wrong = lambda ids, mask: np.where(ids[:, :, None] > 0, np.nan, 0.0) * np.ones(3)
    with pytest.raises(Exception, match="finite"):
        encode_rows(rows, word_ids("text", 50), wrong, max_tokens=30)[0].collect()
    assert counters(encode.batch_plan(rows.withColumn("ids", word_ids("text", 50)), "row_sha256", "ids", 7)).first()["forwards"] == 9


def test_tokens_stay_in_arrow_arrays():
    """A batch of many rows takes little more memory than its arrays: a model's batch alone is copied."""
    import tracemalloc

    import pyarrow as pa

    from tallyloom.operators import encode as E

    rows, n = 2000, 500
    tokens = pa.ListArray.from_arrays(pa.array(range(0, rows * n + 1, n), pa.int32()), pa.array(np.arange(rows * n, dtype=np.int32) % 5000 + 1000))
    batch = pa.RecordBatch.from_arrays([pa.array([i // 8 for i in range(rows)]), pa.array(range(rows)), tokens, pa.array([n] * rows, pa.int32())], ["batch", "ident", "tokens", "padded_to"])
    tracemalloc.start()
    told = sum(b.num_rows for b in E._encode(E.recurrent_states(3))(iter([batch.slice(0, 1003), batch.slice(1003)])))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert told == rows and most < 4 * rows * n
