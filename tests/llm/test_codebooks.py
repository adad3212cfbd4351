"""Vector codes against full Lloyd rounds in whole numbers."""

import hashlib
import math
from collections import defaultdict

import duckdb
import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyloom.llm.codebooks import Codebook, GROUPS, assign, distances, encode_vectors, largest_component
from tallyloom.llm.queries import ORACLES, op11_vector_codes
from tests.llm.conftest import SMALL


def full(rows, parts=8, entries=16, rounds=6):
    """Codes, errors and final codebooks by plain scans; ``rows`` are (id, vector, label)."""
    kept = [(i, [math.floor(4096 * x) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(order[0][1]) // parts if order else 0
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(v, p) for _, v, _ in order[:entries]] for p in range(parts)]

    def nearest(p, part):
        return min((sum((x - y) ** 2 for x, y in zip(part, e)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            groups = defaultdict(list)
            for _, v, _ in kept:
                groups[nearest(p, cut(v, p))[1]].append(cut(v, p))
            books[p] = [[sum(c) // len(groups[k]) for c in zip(*groups[k])] if k in groups else e for k, e in enumerate(books[p])]
    out, by_label = [], defaultdict(int)
    for i, v, lab in kept:
        told = [nearest(p, cut(v, p)) for p in range(parts)]
        out.append((i, "".join(f"{k:02x}" for _, k in told), sum(d for d, _ in told), lab))
        by_label[lab] += out[-1][2]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted([(i, c, e, by_label[lab], sha) for i, c, e, lab in out], key=str)


def found_rows(df):
    return sorted(map(tuple, df.select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()), key=str)


@settings(max_examples=80, deadline=None)
@given(st.integers(0, 1 << 30), st.integers(1, 60), st.integers(1, 9), st.integers(1, 4), st.integers(1, 4))
def test_bounds_skip_nothing_that_counts(seed, n, entries, width, spread):
    """Few different whole numbers, so that distances tie; codes stay those of a full scan through moving codebooks."""
    rng = np.random.default_rng(seed)
    rows = rng.integers(-spread, spread + 1, (n, width))
    book = Codebook.of(rng.integers(-spread, spread + 1, (entries, width)), GROUPS)
    code, upper, lower = np.zeros(n, np.int64), np.full(n, np.inf, np.float32), np.full((n, GROUPS), -np.inf, np.float32)
    for _ in range(5):
        code, upper, lower, _ = assign(rows, code, upper, lower, book)
        assert code.tolist() == distances(rows, book.entries).argmin(axis=1).tolist()
        book = book.replaced(book.entries + rng.integers(-1, 2, (entries, width)) * rng.integers(0, 2, (entries, 1)))


def test_later_rounds_take_fewer_distances(spark):
    seen = []
    encode_vectors(spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet"), seen=seen)
    assert len(seen) == 7 and seen[0] == 500 * 8 * 17 and max(seen[3:]) < seen[0]


def test_the_query_against_full_scans(spark):
    rows = pd.read_parquet(f"{SMALL}/embeddings.parquet")
    told = full(list(zip(rows["vec_id"].tolist(), [v.tolist() for v in rows["embedding"]], rows["label"].tolist())))
    assert found_rows(op11_vector_codes(spark, SMALL)) == told


SCHEMA = "vec_id long, embedding array<float>, label int, code string, `own` string, key string"


def test_awkward_rows(spark):
    """Nulls, NaN, infinity, repeated rows and ids, a null id and label, one vector in a third of all rows."""
    rng = np.random.default_rng(5)
    vectors = [np.float32(rng.normal(size=16)).tolist() for _ in range(60)]
    rows = [(i, v, i % 3) for i, v in enumerate(vectors)] + [(100 + i, vectors[0], None) for i in range(30)]
    rows += [(5, vectors[5], 2), (5, vectors[6], 2), (None, vectors[7], None), (200, None, 1), (201, [*vectors[0][:15], None], 1), (202, [*vectors[0][:15], math.nan], 1), (203, [*vectors[0][:15], -math.inf], 1)]
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA)
    found = encode_vectors(df)
    assert found.columns == ["vec_id", "label", "own", "key", "code", "error", "label_error", "codebooks_sha256"]
    assert found_rows(found) == full(rows)
    assert {(r.own, r.key) for r in found.collect()} == {("y", "z")}


def test_vectors_that_cant_be_compared(spark):
    rows = [(i, [float(i)] * 8, 1) for i in range(4)] + [(7, [1.0] * 9, 1), (8, [], 1), (9, [1e30] * 8, 1), (10, [-5e4] * 8, 1)]
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA)
    found = found_rows(encode_vectors(df))
    told = full([r for r in rows if r[0] not in (7, 8, 9)])
    assert [r for r in found if r[1]] == told
    assert [(r[0], r[2]) for r in found if r[1] is None] == [(7, None), (8, None), (9, None)]
    assert 5e4 * 4096 < largest_component(8) < 1e30


def test_fewer_rows_than_entries_one_row_and_none(spark):
    df = spark.createDataFrame([(i, [float(i % 3), 0.5] * 8, i, "x", "y", "z") for i in range(5)], SCHEMA)
    for n in (5, 1):
        some = df.where(F.col("vec_id") < n)
        assert found_rows(encode_vectors(some)) == full([(r.vec_id, r.embedding, r.label) for r in some.collect()])
    assert encode_vectors(df.limit(0)).count() == 0
    assert encode_vectors(df.where("vec_id < 2").withColumn("embedding", F.array().cast("array<float>"))).select("code", "error").distinct().collect() == [("00" * 8, 0)]
    with pytest.raises(ValueError, match="254"):
        encode_vectors(df, entries=255)


def test_the_sql_agrees(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{SMALL}/embeddings.parquet'")
    told = con.sql(f"SELECT vec_id, code, error, label_error, codebooks_sha256 FROM ({ORACLES['op11_vector_codes']})").fetchall()
    assert sorted(map(tuple, op11_vector_codes(spark, SMALL).collect())) == sorted(told)
