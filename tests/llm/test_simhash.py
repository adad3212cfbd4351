"""SimHash groups against fingerprints bit by bit and all pairs."""

import re
from collections import Counter

import pytest
import xxhash

from tallyloom.llm import components
from tallyloom.llm.components import connected_components
from tallyloom.llm.queries import op2_simhash_groups
from tallyloom.llm.simhash import fingerprint, fingerprint_links, near_duplicates, postings
from tests.llm.conftest import SMALL

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def slow_fingerprint(text, size=3):
    words = WORDS.findall((text or "").translate(LOWER))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + size]) for i in range(len(words) - size + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_groups(prints):
    """The smallest index reachable over links of at most two bits, for every index."""
    least = list(range(len(prints)))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(prints):
            for j, b in enumerate(prints):
                if (a ^ b).bit_count() <= 2 and least[j] < least[i]:
                    least[i], changed = least[j], True
    return least


def test_the_query_against_all_pairs(spark, small_rows):
    rows = small_rows.sort_values("doc_id")
    out = op2_simhash_groups(spark, SMALL).toPandas().sort_values("doc_id")
    prints = [slow_fingerprint(t) for t in rows["text"]]
    ids = rows["doc_id"].tolist()
    assert out["doc_id"].tolist() == ids
    assert out["fingerprint"].tolist() == [f"{p:016x}" for p in prints]
    assert out["component_id"].tolist() == [ids[i] for i in slow_groups(prints)]


@pytest.mark.parametrize("text", [None, "", " \n", "One", "one two", "A b C", "a b c d", "é É a B", "x y z\x1cw q", "w " * 200_001])
def test_fingerprints_one_by_one(text):
    assert fingerprint(text) == slow_fingerprint(text)


def test_more_than_a_chunk_of_shingles():
    text = " ".join(f"w{i % 977}" for i in range(70_000))
    assert fingerprint(text) == slow_fingerprint(text)


@pytest.mark.parametrize("limit", [1, 3, 32])
def test_links_have_the_components_of_all_pairs(spark, limit):
    """Long posting lists are posted once more; whatever the limit, the components are those of all pairs."""
    base = [0x0123456789ABCDEF, 0xFEDCBA9876543210, 0]
    prints = {b ^ (1 << i) ^ (1 << j) for b in base for i in range(0, 64, 7) for j in range(0, 64, 9)}
    prints |= {base[0] ^ 0b1110000 ^ (1 << i) for i in range(20, 40)}
    prints |= {(0x00FF << 48) | (k << 3) for k in range(40)}
    prints = sorted(prints)
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    links = fingerprint_links(spark.createDataFrame(signed, "fp long"), list_limit=limit)
    found = {r.node % (1 << 64): r.component for r in connected_components(links).collect()}
    groups = slow_groups(prints)
    for i, p in enumerate(prints):
        for j, q in enumerate(prints):
            assert (found.get(p, p) == found.get(q, q)) == (groups[i] == groups[j])


def test_components_of_a_long_path(spark):
    links = spark.range(300).selectExpr("id AS u", "id + 1 AS v")
    assert {(r.node, r.component) for r in connected_components(links).collect()} == {(i, 0) for i in range(301)}
    assert connected_components(links.limit(0)).count() == 0


def test_postings_meet_where_six_bytes_are_shared(spark):
    prints = [0x1122334455667788, 0x11223344556677FF, 0x1122334455FF77FF, 0xFF22334455FF77FF, -1]
    rows = postings(spark.createDataFrame([(p,) for p in prints[:3]] + [(prints[3] - (1 << 64),), (-1,)], "fp long")).collect()
    lists = {(r.choice, r.six): [] for r in rows}
    for r in rows:
        lists[r.choice, r.six].append(prints.index(r.fp if r.fp in prints else r.fp + (1 << 64)))
    met = Counter(frozenset((a, b)) for own in lists.values() for a in own for b in own if a < b)
    assert met == {frozenset(k): n for k, n in (((0, 1), 7), ((0, 2), 1), ((1, 2), 7), ((1, 3), 1), ((2, 3), 7))}


def test_stars_whose_centre_is_a_heavy_key(spark, monkeypatch):
    monkeypatch.setattr(components, "BROADCAST_LINKS", 0)
    links = spark.range(1, 1500).selectExpr("if(id < 1200, 5000L, 6000L) AS u", "id AS v").unionByName(spark.createDataFrame([(5000, 6001), (6001, 6002)], "u long, v long"))
    found = {r.node: r.component for r in connected_components(links).collect()}
    assert found == {n: 1 if n < 1200 or n in (5000, 6001, 6002) else 1200 for n in [*range(1, 1500), 5000, 6000, 6001, 6002]}


def test_awkward_rows_and_an_empty_table(awkward, nothing):
    out = near_duplicates(awkward).toPandas()
    assert len(out) == 12
    blank = out[out["fp"] == 0]
    assert len(blank) == 4 and set(blank["component_id"]) == {2}  # the ids 2, 3, 4 and null
    same = out[out["fp"] == out[out["doc_id"] == 1]["fp"].iloc[0]]
    assert len(same) == 4 and set(same["component_id"]) == {1}
    assert near_duplicates(nothing).count() == 0
