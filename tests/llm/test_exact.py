"""Exact deduplication: tries against dictionaries, and the operator against a plain count of texts."""

import hashlib
from collections import defaultdict

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyloom.llm.exact import Trie, dedup_exact, merged
from tallyloom.llm.queries import ORACLES, op12_dedup_exact
from tests.llm.conftest import AWKWARD, SMALL

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def better(a, b, largest):
    if a is None or b is None:
        return b if a is None else a
    return max(a, b) if largest else min(a, b)


def expected(rows, largest=True):
    """Each row's owner, group size and checksum, and for each text how many rows stay."""
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[(text or "").translate(LOWER)].append(doc_id)
    out = []
    for text, ids in groups.items():
        best = ids[0]
        for i in ids:
            best = better(best, i, largest)
        out += [(i, best, len(ids), hashlib.sha256(text.encode()).hexdigest()) for i in ids]
    return sorted(out, key=str), len(groups)


def check(df, rows, largest=True):
    found, (told, texts) = df.collect(), expected(rows, largest)
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in found), key=str) == told
    kept = [r for r in found if r.kept]
    assert all(r.doc_id == r.keep_id for r in kept)
    assert len(kept) == len({r.text_sha256 for r in kept}) == texts


strings = st.lists(st.tuples(st.binary(max_size=6) | st.sampled_from([b"a" * n for n in range(9)]), st.none() | st.integers(0, 9)), max_size=40)


@settings(max_examples=200, deadline=None)
@given(strings, st.booleans())
def test_trie_against_a_dictionary(rows, largest):
    trie, told = Trie(largest), {}
    for text, doc_id in rows:
        assert trie.insert(text, (doc_id, 1, 1), text)
        told[text] = merged(told[text], (doc_id, 1, 1), largest) if text in told else (doc_id, 1, 1)
    assert {text: node.owner for text, node in trie.everything()} == told
    assert trie.texts == len(told) and all(node.key == text for text, node in trie.everything())


@settings(max_examples=200, deadline=None)
@given(strings, st.integers(600, 6000), st.booleans())
def test_what_a_trie_gives_up_is_never_in_it(rows, most, for_good):
    trie, told, left = Trie(True), defaultdict(int), defaultdict(int)
    for text, doc_id in rows:
        told[text] += 1
        if not trie.insert(text, (doc_id, 1, 1), text):
            left[text] += 1
        if trie.size > most:
            for given_up, node in trie.give_up(most // 2, for_good):
                left[given_up] += node.owner[2]
    stays = {text: node.owner[2] for text, node in trie.everything()}
    assert not for_good or not set(stays) & set(left)
    assert {t: stays.get(t, 0) + left.get(t, 0) for t in told} == dict(told)


def test_the_query_against_a_count(spark, small_rows):
    check(op12_dedup_exact(spark, SMALL), list(zip(small_rows["doc_id"].tolist(), small_rows["text"].tolist())))


@pytest.mark.parametrize("options", [{}, {"hash_bytes": 0}, {"trie_bytes": 4000}, {"hash_bytes": 0, "trie_bytes": 2000}, {"keep": "smallest"}])
def test_awkward_rows(spark, awkward, options):
    rows = [(d, t) for d, t, _ in AWKWARD]
    check(dedup_exact(awkward, **options), rows, options.get("keep") != "smallest")


def test_full_tries_and_hot_texts(spark):
    """Subtrees are given up again and again, texts share long beginnings, and one text is a third of all rows."""
    rows = [(i, "The same text " * 20) for i in range(0, 900, 3)] + [(i, "shared beginning " * (i % 7) + str(i // 5 % 60)) for i in range(900) if i % 3]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    for trie_bytes in (3000, 20_000):
        check(dedup_exact(df, trie_bytes=trie_bytes), rows)


def test_columns_come_along(spark, awkward):
    found = dedup_exact(awkward, columns=["size", "text"]).select("doc_id", F.col("own.size").alias("size"), F.col("own.text").alias("text"), "kept").collect()
    assert sorted([(r.doc_id, r.text) for r in found], key=str) == sorted([(d, t) for d, t, _ in AWKWARD], key=str)
    assert {r.size for r in found} == {"extra"}


def test_an_empty_table_and_a_wrong_choice(spark, nothing):
    assert dedup_exact(nothing).count() == 0
    with pytest.raises(ValueError, match="keep"):
        dedup_exact(nothing, keep="newest")


def test_the_sql_agrees(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SMALL}/documents.parquet'")
    told = con.sql(f"SELECT doc_id, keep_id, group_size, kept, text_sha256 FROM ({ORACLES['op12_dedup_exact']})").fetchall()
    assert sorted(map(tuple, op12_dedup_exact(spark, SMALL).collect())) == sorted(told)
