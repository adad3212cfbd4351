"""Bit packing: exact round trips, random access, and ids as the tokenizer gives them."""

import io
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tallyloom.llm.binpack import PieceEncoder, ShardReader, ShardWriter, bits_for, pack, read_tokens, unpack, write_tokens
from tallyloom.llm.queries import op3_pack_tokens
from tests.llm.conftest import AWKWARD, SMALL

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def encoder():
    return PieceEncoder(PATH)


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 31), st.data())
def test_pack_and_unpack(bits, data):
    ids = np.array(data.draw(st.lists(st.integers(0, (1 << bits) - 1), max_size=70)), dtype=np.uint32)
    packed = pack(ids, bits)
    assert len(packed) == -(-len(ids) * bits // 8)
    assert unpack(packed, bits, len(ids)).tolist() == ids.tolist()


def test_bits():
    assert [bits_for(v) for v in (1, 2, 3, 256, 257, 50_257)] == [1, 1, 2, 8, 9, 16]


@settings(max_examples=30, deadline=None)
@given(st.lists(st.lists(st.integers(0, 999), max_size=40), max_size=12), st.integers(1, 17))
def test_random_access(documents, block_ids):
    out = io.BytesIO()
    writer = ShardWriter(out, 10, block_ids)
    for i, ids in enumerate(documents):
        writer.add(None if i == 2 else i, np.array(ids, dtype=np.uint32))
    writer.close()
    reader = ShardReader(io.BytesIO(out.getvalue()))
    flat = sum(documents, [])
    assert reader.read(0, reader.ids).tolist() == flat
    for i, ids in enumerate(documents):
        assert reader.document(i).tolist() == ids
    for a in range(0, len(flat), 7):
        assert reader.read(a, min(len(flat), a + 5)).tolist() == flat[a : a + 5]
    assert [x.tolist() for _, x in reader.each(11)] == documents
    assert reader.known.tolist() == [i != 2 for i in range(len(documents))]


texts = st.lists(st.text(alphabet=st.sampled_from("ab'Ss 1\n\t 　éß字.,!  <|endoftext|>\r\x1c"), max_size=40), max_size=8)


@settings(max_examples=300, deadline=None)
@given(texts)
def test_pieces_are_the_tokenizers(tokenizer, encoder, rows):
    found = [ids[a:b].tolist() for ids, bounds in encoder.encode(pa.array(rows, pa.string())) for a, b in zip(bounds, bounds[1:])]
    assert found == [tokenizer.encode(t, add_special_tokens=False).ids for t in rows]


def test_special_tokens_are_the_tokenizers(encoder):
    [(ids, bounds)] = encoder.encode(pa.array(["a <|endoftext|> b"]))
    assert ids.tolist() == [64, 220, 50256, 275] and bounds.tolist() == [0, 4]


def test_texts_of_many_runs(tokenizer, encoder, monkeypatch):
    """Runs, new words and remembered ones are cut anew without a change of ids."""
    rng = np.random.default_rng(1)
    rows = [" ".join(f"w{n}" for n in rng.zipf(1.3, size)) for size in (1, 700, 0, 50, 3000, 2)] + ["two  spaces " * 40, "x <|endoftext|>"]
    expected = [tokenizer.encode(t, add_special_tokens=False).ids for t in rows * 3]
    for name, value in (("RUN_WORDS", 64), ("FRESH_WORDS", 7), ("MEMO_WORDS", 20)):
        monkeypatch.setattr(f"tallyloom.llm.binpack.{name}", value)
    encoder = PieceEncoder(PATH)
    found = [ids[a:b].tolist() for _ in range(3) for ids, bounds in encoder.encode(pa.array(rows)) for a, b in zip(bounds, bounds[1:])]
    assert found == expected


def expected(tokenizer, rows):
    start, out = 0, []
    for doc_id, text in rows:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        out.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_the_query_against_the_tokenizer(spark, small_rows, tokenizer):
    rows = small_rows.sort_values("doc_id")
    found = sorted(map(tuple, op3_pack_tokens(spark, SMALL).collect()))
    assert found == expected(tokenizer, zip(rows["doc_id"].tolist(), rows["text"].tolist()))


def test_awkward_rows_and_an_empty_table(spark, awkward, nothing, tokenizer, tmp_path):
    write_tokens(awkward, f"{tmp_path}/awkward", PATH, vocabulary=50_257, block_ids=100)
    found = sorted(map(tuple, read_tokens(spark, f"{tmp_path}/awkward").collect()), key=lambda r: r[1])
    assert [r[0] for r in found] == sorted(r[0] for r in AWKWARD if r[0] is not None) + [None, None]
    sums = lambda rows: sorted((str(r[0]), r[2], r[3]) for r in rows)
    assert sums(found) == sums(expected(tokenizer, [(d, t) for d, t, _ in AWKWARD]))
    assert [r[1] for r in found] == np.cumsum([0, *(r[2] for r in found)])[:-1].tolist()
    assert write_tokens(nothing, f"{tmp_path}/nothing", PATH, vocabulary=50_257) == []
    assert read_tokens(spark, f"{tmp_path}/nothing").count() == 0


def test_a_closing_mark_is_no_word_of_its_own(tokenizer, monkeypatch):
    """A word and the same word before a full stop or comma are remembered once; words of letters skip the splitter."""
    rows = ["x alpha alpha. alpha, alpha.. beta. beta 7. 7 é. it's. it's ., . , ß, a1. alpha."]
    encoder = PieceEncoder(PATH)
    for _ in range(2):
        [(ids, _)] = encoder.encode(pa.array(rows))
        assert ids.tolist() == tokenizer.encode(rows[0], add_special_tokens=False).ids
    assert "alpha" in encoder.recent and not {"alpha.", "alpha,", "7."} & set(encoder.recent)
