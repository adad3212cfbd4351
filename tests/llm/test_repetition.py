"""Repetition against every pair of positions."""

import re
from collections import Counter

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyloom.llm.queries import op6_quality_repeats
from tallyloom.llm.repetition import MAX_COVERED, MAX_LONGEST, MIN_REPEAT, measure, repetition
from tests.llm.conftest import SMALL

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def slow_longest(words):
    """For every position the longest substring that begins there and somewhere else, by dynamic programming."""
    n = len(words)
    longest, below = [0] * n, [0] * (n + 1)
    for i in reversed(range(n)):
        row = [0] * (n + 1)
        for j in reversed(range(n)):
            if i != j and words[i] == words[j]:
                row[j] = below[j + 1] + 1
        longest[i] = max(row, default=0)
        below = row
    return longest


def slow(text, min_repeat=MIN_REPEAT):
    text = text or ""
    words = WORDS.findall(text)
    windows = Counter(zip(words, words[1:], words[2:]))
    again = {i + k for i, w in enumerate(zip(words, words[1:], words[2:])) if windows[w] > 1 for k in range(3)}
    longest = slow_longest(words)
    covered = {i + k for i, length in enumerate(longest) if length >= min_repeat for k in range(length)}
    lines = [line for line in text.split("\n") if WORDS.search(line)]
    return {
        "n_words": len(words),
        "word_chars": sum(map(len, words)),
        "n_symbols": sum(c in "#*$%&|<>" for c in text),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(again),
        "covered_words": len(covered),
        "longest_repeat": max(longest, default=0),
    }


def verdict(m):
    failed = m["n_words"] < 50 or 100 * m["n_repeat_words"] > 50 * m["n_words"]
    return failed, not failed and m["covered_words"] <= MAX_COVERED * m["n_words"] and m["longest_repeat"] <= MAX_LONGEST


texts = st.lists(st.one_of(st.none(), st.lists(st.sampled_from(["a", "b", "c", "a b c", "\n", "\t#", "é*", "a b\nc"]), max_size=40).map(" ".join)), min_size=1, max_size=5)


@settings(max_examples=200, deadline=None)
@given(texts, st.integers(1, 5))
def test_against_every_pair_of_positions(rows, min_repeat):
    found = measure(pa.array(rows, pa.string()), min_repeat)
    for i, text in enumerate(rows):
        assert {k: int(v[i]) for k, v in found.items()} == slow(text, min_repeat)


def test_the_query(spark, small_rows):
    rows = {d: t for d, t in zip(small_rows["doc_id"].tolist(), small_rows["text"].tolist())}
    out = op6_quality_repeats(spark, SMALL).collect()
    assert len(out) == len(rows)
    for r in out:
        if len(WORDS.findall(rows[r.doc_id] or "")) > 1500:  # quadratic
            continue
        expected = slow(rows[r.doc_id])
        assert {k: r[k] for k in expected} == expected
        assert (r.base_failed, r.kept) == verdict(expected)


def test_a_long_repeat_is_not_kept(spark):
    passage = " ".join(f"word{i}" for i in range(61))
    rest = " ".join(f"other{i}" for i in range(900))
    rows = [(1, f"{passage} {rest} {passage}"), (2, f"{passage} {rest}"), (3, " ".join(f"w{i}" for i in range(12)) + " " + rest + " " + " ".join(f"w{i}" for i in range(12)))]
    out = {r.doc_id: r for r in repetition(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (out[1].longest_repeat, out[1].covered_words, out[1].kept, out[1].base_failed) == (61, 122, False, False)
    assert (out[2].longest_repeat, out[2].kept) == (0, True)
    assert (out[3].longest_repeat, out[3].covered_words, out[3].kept) == (12, 24, True)


def test_awkward_rows_and_an_empty_table(awkward, nothing):
    out = repetition(awkward).toPandas()
    assert len(out) == 12
    assert out[out["n_words"] == 0]["base_failed"].tolist() == [True] * 4
    assert not out[out["doc_id"] == 8]["kept"].any() and out[out["doc_id"] == 8]["longest_repeat"].tolist() == [119_999]
    assert repetition(nothing).count() == 0
