"""Near duplicates at a similarity of 0.8 against all pairs of shingle sets."""

import random
import re
from itertools import combinations

import numpy as np
import pytest

from tallyloom.llm import similar
from tallyloom.llm.similar import byte_triples, shingle_hashes, similar_documents, similarity_of, wide_fingerprint

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def slow_shingles(text):
    words = WORDS.findall((text or "").translate(LOWER))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def slow_components(rows, least=0.8):
    """The smallest id reachable for each row's place; rows are ``(doc_id, text)``."""
    sets = [slow_shingles(t) for _, t in rows]
    name = list(range(len(rows)))

    def top(i):
        while name[i] != i:
            i = name[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if a == b or (min(len(a), len(b)) >= least * max(len(a), len(b)) and len(a & b) >= least * len(a | b) - 1e-9):
            name[max(top(i), top(j))] = min(top(i), top(j))
    ids = {}
    for i, (doc_id, _) in enumerate(rows):
        ids.setdefault(top(i), []).append(doc_id)
    return [min((d for d in ids[top(i)] if d is not None), default=None) for i in range(len(rows))]


def near_copies(seed, bases, copies, edits, words=120):
    rng = random.Random(seed)
    pool = [f"word{i}" for i in range(5000)]
    rows = []
    for _ in range(bases):
        base = rng.choices(pool, k=words)
        for copy in range(copies):
            own = list(base)
            for _ in range(edits if copy else 0):
                own[rng.randrange(len(own))] = rng.choice(pool)
            rows.append((len(rows), " ".join(own)))
    return rows


def test_triples_cover_pairs_evenly():
    found = byte_triples()
    assert len(set(found)) == len(found) == similar.TRIPLES
    assert {p for t in found for p in t} == set(range(32))


@pytest.mark.parametrize("text", [None, "", "one", "A b c d", "a b c d e", "a b c d e f a b c d e f", "é \x1c x"])
def test_shingles(text):
    assert len(shingle_hashes(text)) == len(slow_shingles(text))


def test_similar_fingerprints_keep_to_the_bounds():
    """Pairs of similarity 0.8 differ in few enough bits and share enough bytes, for all but a few in a thousand."""
    rng = np.random.default_rng(3)
    bits, shared = [], []
    for _ in range(500):
        h = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
        a, b = np.sort(h[:270]), np.sort(h[30:])
        assert similarity_of(a, b) == pytest.approx(0.8)
        x, y = wide_fingerprint(a).view(np.uint8), wide_fingerprint(b).view(np.uint8)
        bits.append(int(np.unpackbits(x ^ y).sum()))
        shared.append(int((x == y).sum()))
    assert np.mean(np.array(bits) <= similar.MOST_BITS) >= 0.99
    assert np.mean(np.array(shared) >= similar.LEAST_SHARED_BYTES) >= 0.99


def check(spark, rows, least_found):
    out = {r.doc_id: r.component_id for r in similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(out) == len(rows)
    expected = dict(zip([d for d, _ in rows], slow_components(rows)))
    for doc_id, component in out.items():  # never more than all pairs would join
        assert expected[component] == expected[doc_id]
    linked = [d for d in expected if expected[d] != d]
    assert sum(out[d] == expected[d] for d in linked) >= least_found * len(linked)
    return out


def test_groups_of_near_copies(spark):
    rows = near_copies(1, 40, 4, 2) + [(1000 + i, f"alone {i} " + " ".join(f"u{i}x{j}" for j in range(60))) for i in range(100)]
    check(spark, rows, 0.9)


def test_a_large_group_meets_its_busiest_member(spark):
    """Three hundred copies, each near to the original but not always to each other, are one group."""
    rows = near_copies(2, 1, 300, 3, words=200)
    out = check(spark, rows, 0.97)
    assert len(set(out.values())) <= 9


def test_awkward_rows_and_an_empty_table(awkward, nothing):
    out = similar_documents(awkward).toPandas()
    assert len(out) == 12
    same = out[out["component_id"] == 1]
    assert len(same) == 4  # ids 1, 1, 5 and null
    assert (out["component_id"] == 2).sum() == 4  # the texts without words
    assert similar_documents(nothing).count() == 0


@pytest.mark.parametrize("words,edits", [(8, 1), (9, 1), (54, 1), (120, 2), (120, 3), (300, 6)])
def test_every_similar_pair_is_joined(spark, words, edits):
    """Pairs on both sides of 0.8, of short texts too: exactly the components of all pairs."""
    rows = near_copies(words + edits, 60, 2, edits, words=words)
    rows += [(10_000 + i, " ".join(t.split()[1:])) for i, t in rows[: 2 * 30 : 2]]
    check(spark, rows, 1)


def test_a_template_below_the_similarity_makes_no_pairs(spark, monkeypatch):
    """Texts that share most of a passage but aren't similar are not paired off, nor is one missed that is similar."""
    template = " ".join(f"shared{i}" for i in range(120))
    rows = [(i, template + " " + " ".join(f"own{i}x{j}" for j in range(40))) for i in range(300)]
    rows.append((1000, rows[7][1] + " end"))
    asked, verified = [], similar._verified
    monkeypatch.setattr(similar, "_verified", lambda pairs, *rest: asked.append(pairs.count()) or verified(pairs, *rest))
    out = check(spark, rows, 1)
    assert out[1000] == 7
    assert sum(asked[1:]) <= 2 * len(rows)


def test_texts_of_one_fingerprint_are_verified(spark, monkeypatch):
    """Equal fingerprints make candidates, not links: with a constant one the components are still those of all pairs."""

    def constant(shingle_words):
        def run(batches):
            import pyarrow as pa

            for b in batches:
                zeros = pa.array([0] * b.num_rows, pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), zeros, zeros, zeros, zeros], ["doc_id", "print", "f0", "f1", "f2", "f3"])

        return run

    monkeypatch.setattr(similar, "_prints", constant)
    check(spark, near_copies(11, 15, 2, 2), 1)
