"""Decontamination against every window of every document."""

from collections import Counter

import pytest
import regex

from tallyloom.llm.decontam import RADIUS, contaminated, shingles_of, simhash, weighted_similarity
from pyspark.sql import functions as F

BETWEEN = regex.compile(r"[^\p{L}\p{N}]+")


def words(text):
    return [w for w in BETWEEN.split((text or "").lower()) if w]


def shingled(tokens, size):
    return [tuple(tokens[i : i + size]) for i in range(len(tokens) - size + 1)]


def similarity(a, b):
    shared = sum((Counter(a) & Counter(b)).values())
    return shared / (len(a) + len(b) - shared)


def slow(docs, items, least=0.8):
    """``{(doc_id, item_id): (similarity, start)}`` by exact similarity of all windows of the item's size."""
    out = {}
    for item_id, item in items:
        size = min(5, len(words(item)))
        if item_id is None or not size:
            continue
        target = shingled(words(item), size)
        for doc_id, text in docs:
            every = shingled(words(text), size)
            window = min(len(every), len(target))
            for start in range(len(every) - window + 1) if every else ():
                found = similarity(every[start : start + window], target)
                best = out.get((doc_id, item_id), (0, 0))
                if found >= least - 1e-12 and (found, -start) > (best[0], -best[1]):
                    out[doc_id, item_id] = (found, start)
    return out


ITEM = "The red fox jumps over a lazy dog while seven quiet owls watch from the old barn roof and count every star that falls"
REPEATS = "again and again and again and again and again and again the wheel turns and again and again it stops"
OTHER = "Which of these four numbers is the largest prime below one hundred and how would you prove it to a friend"


def changed(text, *at):
    tokens = text.split()
    for i in at:
        tokens[i] = f"other{i}"
    return " ".join(tokens)


DOCS = [
    (1, "some words before " + ITEM + " and after them"),
    (2, changed(ITEM, 0) + " tail"),
    (3, "head " + changed(ITEM, 23)),
    (4, changed(ITEM, 10)),  # five of nineteen shingles differ: too far
    (5, ITEM.upper().replace(" ", ",  ")),
    (6, " ".join(ITEM.split()[:22])),
    (7, REPEATS + ". " + OTHER),
    (8, "nothing of the kind stands in here, only plain words of no item"),
    (9, None),
    (10, ""),
    (None, OTHER),
    (11, "x " * 30_000 + OTHER + " y" * 1000),
    (11, ITEM),
    (12, "yes it is"),
    (13, ITEM + " " + changed(ITEM, 23) + " " + ITEM),
]
ITEMS = [(1, ITEM), (2, OTHER), (3, REPEATS), (4, "It is"), (5, None), (6, " "), (None, ITEM), (1, ITEM)]


@pytest.fixture(scope="module")
def found(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string").withColumns({c: F.lit("extra") for c in ("item_id", "print", "start", "window", "words", "all")})
    items = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("item", F.lit(1))
    return contaminated(docs, items).collect()


def test_against_every_window(found):
    expected = slow(DOCS, ITEMS)
    assert {(1, 1), (2, 1), (3, 1), (5, 1), (6, 1), (7, 2), (7, 3), (None, 2), (11, 1), (11, 2), (13, 1), (12, 4)} <= set(expected)
    assert (4, 1) not in expected
    assert {(r.doc_id, r.item_id) for r in found} == set(expected) and len(found) == len(expected)
    for r in found:
        assert r.start >= expected[r.doc_id, r.item_id][1]  # a window is moved on to its first shared shingle
        assert r.similarity == pytest.approx(expected[r.doc_id, r.item_id][0])
        assert 0 <= r.distance <= RADIUS


def test_similar_windows_are_within_the_radius(spark):
    """Fingerprints of windows at a similarity of 0.8 differ in fewer bits than the radius, for all of many items."""
    rows = [(i, [(i * 1009 + j) % 100_003 for j in range(45)], [(i * 1009 + j) % 100_003 if j >= 5 else -i * 10 - j for j in range(45)]) for i in range(400)]
    df = spark.createDataFrame(rows, "i int, a array<int>, b array<int>")
    hashed = lambda c: F.transform(c, lambda x: F.xxhash64(x))
    out = df.select(F.bit_count(simhash(hashed("a")).bitwiseXOR(simhash(hashed("b")))).alias("d"), weighted_similarity(hashed("a"), hashed("b")).alias("s"))
    worst = out.agg(F.max("d"), F.min("s")).first()
    assert worst[1] == pytest.approx(0.8)
    assert worst[0] <= RADIUS


def test_short_lists_have_no_shingles(spark):
    df = spark.createDataFrame([(["a", "b"],), ([],)], "w array<string>")
    assert [r[0] for r in df.select(F.size(shingles_of(F.col("w"), 3))).collect()] == [0, 0]


def test_empty_tables(spark):
    docs, items = spark.createDataFrame(DOCS, "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")
    assert contaminated(docs, items.limit(0)).count() == 0
    assert contaminated(docs.limit(0), items).count() == 0


def test_small_tables_against_every_window(spark):
    docs, items = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "benchmark"))
    some = [(r.doc_id, r.text) for r in docs.collect()]
    expected = slow(some, [(r.item_id, r.text) for r in items.collect()])
    found = contaminated(docs, items).collect()
    assert {(r.doc_id, r.item_id): r.start for r in found} == {k: v[1] for k, v in expected.items()}
