"""Mixing against subset sums by enumeration and targets by water filling."""

import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyloom.llm.mixing import fit_lengths, knapsack, mix_sources
from tallyloom.llm.queries import op1_mix_sources
from tests.llm.conftest import SMALL

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def best_sum(sizes, counts, budget):
    reached = {0}
    for size, count in zip(sizes, counts):
        for _ in range(count if size else 0):
            reached |= {r + size for r in reached if r + size <= budget}
    return max(reached)


lengths = st.lists(st.tuples(st.integers(0, 25), st.integers(0, 4)), min_size=1, max_size=6, unique_by=lambda x: x[0])


@settings(max_examples=150, deadline=None)
@given(lengths, st.integers(0, 150))
def test_knapsack_reaches_the_best_sum(cells, budget):
    sizes, counts = (np.array(x, dtype=np.int64) for x in zip(*cells))
    taken = knapsack(sizes, counts, budget)
    assert (taken >= 0).all() and (taken <= counts).all()
    assert (taken * sizes).sum() == best_sum(sizes.tolist(), counts.tolist(), budget)


@settings(max_examples=80, deadline=None)
@given(lengths, st.integers(0, 200), st.integers(1, 60))
def test_fit_stays_within_the_budget(cells, budget, window):
    sizes, counts = (np.array(x, dtype=np.int64) for x in zip(*cells))
    taken = fit_lengths(sizes, counts, budget, window)
    assert (taken >= 0).all() and (taken <= counts).all()
    got = int((taken * sizes).sum())
    assert got <= max(budget, 0)
    left = sizes[(taken < counts) & (sizes > 0)]
    assert not len(left) or budget - got < left.min()
    if budget <= window:
        assert got == best_sum(sizes.tolist(), counts.tolist(), budget)


def test_documents_beyond_the_window():
    """Documents longer than the window are rounded down, never over the budget."""
    assert fit_lengths([100_000], [10], 490_000).tolist() == [4]
    assert fit_lengths([100_000, 30, 7], [10, 2000, 5000], 490_001).dot([100_000, 30, 7]) == 490_001


def water_fill(sizes, weights, share, most):
    """Targets by the contract: share by weight, cap, and share the excess among those below their caps again."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, target, open_ = share * sum(sizes.values()), {}, list(names)
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if weight[s] * level > most * sizes[s]]
        if not full:
            target |= {s: weight[s] * level for s in open_}
            break
        for s in full:
            target[s] = most * sizes[s]
            left -= target[s]
        open_ = [s for s in open_ if s not in full]
    return target


def test_the_query_keeps_its_contract(spark, small_rows):
    out = op1_mix_sources(spark, SMALL).toPandas().set_index("doc_id").sort_index()
    rows = small_rows.set_index("doc_id").sort_index()
    assert list(out.index) == list(rows.index)
    size = rows["text"].map(lambda t: len(WORDS.findall(t or "")))
    assert (out["size"] == size).all()
    source = rows["source"].where(rows["source"].notna(), None)
    totals = {s: int(size[(source == s) if s is not None else source.isna()].sum()) for s in set(source)}
    targets = water_fill(totals, (5, 2, 1), 1.5, 2)
    longest = int(size.max())
    for s, target in targets.items():
        own = out[(source == s) if s is not None else source.isna()]
        assert (own["source_size"] == totals[s]).all()
        assert np.allclose(own["target"], target)
        assert target <= 2 * totals[s] + 1e-6
        assert abs(own["taken"].sum() - target) <= longest
    assert (out["taken"] <= 2 * out["size"]).all()
    assert (out["taken"] == out["size"] * out["copies"]).all()
    again = op1_mix_sources(spark, SMALL).toPandas().set_index("doc_id").sort_index()
    assert again.equals(out)


def test_awkward_rows_and_an_empty_table(awkward, nothing):
    out = mix_sources(awkward).toPandas()
    assert len(out) == 12
    assert (out["taken"] <= 2 * out["size"]).all()
    assert out[out["doc_id"] == 2]["size"].tolist() == [0]
    assert set(out["source_key"]) == {"sa", "sb", "s", "sc", "t"}
    assert mix_sources(nothing).count() == 0


def test_equal_lengths_and_one_hot_source(spark):
    """Ties in length are broken by a seeded hash; a source may hold almost everything."""
    rows = spark.range(3000).selectExpr("id AS doc_id", "repeat('w ', 1 + int(id % 3)) AS text", "if(id < 2900, 'hot', 'cold') AS source")
    out = mix_sources(rows).toPandas()
    assert len(out) == 3000 and out["doc_id"].is_unique
    for _, own in out.groupby("source_key"):
        assert abs(own["taken"].sum() - own["target"].iloc[0]) <= 1
