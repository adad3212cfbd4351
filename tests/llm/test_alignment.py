"""Cross-tokenizer alignment against plain loops over tokens, and against the tokenizers on whole texts."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from tallyloom.llm import alignment
from tallyloom.llm.alignment import Aligner, Bits, _cut_up, _packed, _unpacked, align
from tallyloom.llm.queries import op13_align_tokens
from tests.llm.conftest import AWKWARD, SMALL

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def both():
    first = Tokenizer.from_file(A)
    first.encode_special_tokens = True
    return first, SentencePieceProcessor(model_file=B)


def byte_of():
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = sorted(set(range(256)) - set(shown))
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def plain(both, text):
    """Groups and links of a text by loops, or None where it has no tokens."""
    if not text:
        return None
    first, second = both
    table, own = byte_of(), f" {text}".encode()
    a = first.encode(f" {text}", add_special_tokens=False)
    a_bytes = [bytes(table[c] for c in t) for t in a.tokens]
    b_ids = second.encode(text)
    b_bytes = [bytes([int(p[3:-1], 16)]) if second.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(b_ids, map(second.id_to_piece, b_ids))]
    if b"".join(a_bytes) != own or b"".join(b_bytes) != own:
        return None
    spans = []
    for ids, pieces in ((a.ids, a_bytes), (b_ids, b_bytes)):
        at, out = 0, []
        for i, piece in zip(ids, pieces):
            out.append((i, at, at + len(piece)))
            at += len(piece)
        spans.append(out)
    cuts = sorted({e for _, _, e in spans[0]} & {e for _, _, e in spans[1]})
    groups, low = [], 0
    for high in cuts:
        groups.append("|".join(",".join(str(i) for i, s, e in side if low <= s and e <= high) for side in spans))
        low = high
    holder = [[k for k, (_, s, e) in enumerate(side) for _ in range(s, e)] for side in spans]  # whose each byte is
    links = [(spans[0][i][0], spans[1][j][0]) for i, j in set(zip(*holder))]
    return len(a.ids), len(b_ids), groups, links


def expected(both, rows):
    found = [(doc_id, plain(both, text)) for doc_id, text in rows]
    counts = Counter(link for _, x in found if x for link in x[3])
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(best.get(b, 0), n)
    out = []
    for doc_id, x in found:
        if x is None:
            out.append((doc_id, 0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, groups, links = x
        out.append((doc_id, n_a, n_b, len(groups), len(links), sum(counts[k] == best[k[1]] for k in links), sum(counts[k] for k in links), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return sorted(out, key=str)


def found_rows(df):
    return sorted(map(tuple, df.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()), key=str)


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(0, 299)), st.sets(st.integers(0, 299)))
def test_ranks_and_selections(a, b):
    first, second = (Bits.of(np.array(sorted(x), dtype=np.int64), 300) for x in (a, b))
    assert first.select().tolist() == sorted(a)
    assert (first & second).select().tolist() == sorted(a & b)
    assert (first | second).select().tolist() == sorted(a | b)
    places = np.arange(321)
    assert first.rank(places).tolist() == [sum(x < p for x in a) for p in places]


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(0, 1 << 47), st.integers(1, 1 << 40), max_size=40))
def test_pairs_come_back(counts):
    codes = np.array(sorted(counts), dtype=np.int64)
    told = _unpacked(_packed(codes, np.array([counts[c] for c in codes.tolist()], dtype=np.int64)))
    assert told[0].tolist() == codes.tolist() and told[1].tolist() == [counts[c] for c in codes.tolist()]


@pytest.fixture(scope="module")
def aligner():
    return Aligner(A, B)


texts = st.lists(st.text(alphabet=st.sampled_from("ab'Ss 1\n\t 　éß字.,!  ▁<|endoftext|>\r\x1c\x00\U0001f600"), max_size=30), max_size=6)


@settings(max_examples=250, deadline=None)
@given(texts)
def test_units_are_the_texts(both, aligner, rows):
    """Groups and links of words put together are those of the tokenizers on whole texts."""
    column = pa.array(rows, pa.string())
    if not rows:
        return
    words, whole, place, bounds = _cut_up(column)
    found, at = aligner.units(words, whole)
    starts = np.cumsum(found.numbers[:, 3]) - found.numbers[:, 3]
    for i, text in enumerate(rows):
        own, told = at[place[bounds[i] : bounds[i + 1]]], plain(both, text)
        if told is None:
            assert not len(own) or not found.sound[own].all()
            continue
        links = [(int(p) >> 31, int(p) & ((1 << 31) - 1)) for u in own for p in found.pairs[starts[u] : starts[u] + found.numbers[u, 3]]]
        assert b";".join(found.groups[u] for u in own).decode() == ";".join(told[2])
        assert Counter(links) == Counter(told[3])


def test_a_small_memory_changes_nothing(both, monkeypatch):
    monkeypatch.setattr(alignment, "MEMO_UNITS", 20)
    monkeypatch.setattr(alignment, "FRESH_BYTES", 64)
    rng = np.random.default_rng(3)
    known = Aligner(A, B)
    for _ in range(8):
        rows = [" ".join(f"wört{n}▁" if n == 7 else f"wört{n}" for n in rng.zipf(1.3, 40).tolist()) for _ in range(5)] + ["two  spaces here"]
        words, whole, place, bounds = _cut_up(pa.array(rows))
        found, at = known.units(words, whole)
        assert len(known.index) == len(known.uses) <= len(known.known.sound)
        for i, text in enumerate(rows):
            own, told = at[place[bounds[i] : bounds[i + 1]]], plain(both, text)
            assert bool(found.sound[own].all()) == (told is not None)
            assert told is None or b";".join(found.groups[u] for u in own).decode() == ";".join(told[2])


def test_the_query_against_loops(spark, small_rows, both):
    rows = list(zip(small_rows["doc_id"].tolist(), small_rows["text"].tolist()))
    assert found_rows(op13_align_tokens(spark, SMALL)) == expected(both, rows)


def test_awkward_rows_joined_and_broadcast(spark, awkward, nothing, both, monkeypatch):
    rows = [(d, t) for d, t, _ in AWKWARD if t is None or len(t) < 10_000]
    short = awkward.where("text IS NULL OR length(text) < 10000")
    whole = found_rows(align(short, A, B))
    assert whole == expected(both, rows)
    monkeypatch.setattr(alignment, "BROADCAST_PAIRS", 3)
    monkeypatch.setattr(alignment, "HELD_PAIRS", 8)
    assert found_rows(align(short, A, B)) == whole
    assert align(nothing, A, B).count() == 0


def test_a_very_long_text_and_its_groups(spark, awkward):
    [row] = align(awkward.where("doc_id = 8"), A, B, keep_groups=True).collect()
    assert (row.n_a, row.n_b, row.n_groups) == (120_001, 120_001, 120_001)
    assert hashlib.sha256(row.groups.encode()).hexdigest() == row.groups_sha256


def test_special_tokens_are_plain_text(both):
    assert plain(both, "a <|endoftext|> b") is not None
    found, at = Aligner(A, B).units(["<|endoftext|>"], [])
    assert b"50256" not in found.groups[at[0]]
