"""Token ids in fixed-width bit packing: shard files with block offsets, written and read by Spark tasks.

A shard file holds, little-endian throughout::

    magic            8 bytes, b"TLPACK01"
    blocks           each of ``block_ids`` ids (the last may be shorter), ``bits`` bits an id, low bits first, padded to a byte
    block offsets    uint64 for each block and one for the end
    document starts  uint64 for each document and one for the end, in ids of this file
    document ids     int64 for each document
    id known         uint8 for each document, 0 where the document's id is null
    trailer          uint32 bits, uint32 block_ids, uint64 ids, uint64 documents, uint64 where the block offsets begin

A block is read on its own by its offset and unpacked by one numpy call, so any range of ids or any document can be read
without the rest of the file. Ids are in ascending document-id order over the shards of one write, nulls last.

Tasks write to the shared folder under names that no other attempt uses, and report them; only reported files are in
the manifest, so a task that is run again leaves no trace in what is read.
"""

from __future__ import annotations

import functools
import json
import os
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator
from typing import BinaryIO

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.llm.common import frugal, small_batches, text_runs

MAGIC = b"TLPACK01"
TRAILER = struct.Struct("<IIQQQ")
BLOCK_IDS = 1 << 14
END_ID = 0
#: Bytes of text whose words are looked up together, and words whose ids are put together (a longer text stands alone).
RUN_BYTES, RUN_WORDS = 2 << 20, 1 << 15
#: New words that are given to the tokenizer at once, which takes some hundred bytes for each of their bytes.
FRESH_WORDS = 1 << 12
#: Marks that are taken off the end of a word.
CLOSING = ".,"
#: Words after which a worker's memory of their ids becomes the older of two; what isn't met again goes with the next.
MEMO_WORDS = 80_000


def bits_for(vocabulary: int) -> int:
    """The least number of bits that holds every id below ``vocabulary``."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """``ids`` at ``bits`` bits each, low bits first."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    planes = (ids.astype(np.uint64)[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(planes.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(data: bytes, bits: int, count: int) -> np.ndarray:
    """The first ``count`` ids of ``data``."""
    if bits in (8, 16, 32):
        return np.frombuffer(data, dtype=f"<u{bits // 8}", count=count).astype("<u4")
    planes = np.unpackbits(np.frombuffer(data, dtype=np.uint8), count=count * bits, bitorder="little").reshape(count, bits)
    return (planes.astype(np.uint64) << np.arange(bits, dtype=np.uint64)).sum(axis=1).astype("<u4")


class ShardWriter:
    """Appends documents to one shard file; holds one block of ids and 17 bytes a document."""

    def __init__(self, out: BinaryIO, bits: int, block_ids: int = BLOCK_IDS) -> None:
        self.out, self.bits, self.block_ids = out, bits, block_ids
        self.waiting: list[np.ndarray] = []
        self.held, self.ids, self.at = 0, 0, len(MAGIC)
        self.offsets, self.starts, self.doc_ids, self.known = [self.at], [0], [], bytearray()
        out.write(MAGIC)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.waiting.append(ids)
        self.held += len(ids)
        self.ids += len(ids)
        self.starts.append(self.ids)
        self.doc_ids.append(0 if doc_id is None else doc_id)
        self.known.append(doc_id is not None)
        if self.held >= self.block_ids:
            self._blocks(last=False)

    def _blocks(self, last: bool) -> None:
        ids = np.concatenate(self.waiting) if self.waiting else np.zeros(0, dtype=np.uint32)
        whole = len(ids) if last else len(ids) - len(ids) % self.block_ids
        for start in range(0, whole, self.block_ids):
            data = pack(ids[start : min(whole, start + self.block_ids)], self.bits)
            self.out.write(data)
            self.at += len(data)
            self.offsets.append(self.at)
        self.waiting, self.held = [ids[whole:]], len(ids) - whole

    def close(self) -> None:
        self._blocks(last=True)
        for values, kind in ((self.offsets, "<u8"), (self.starts, "<u8"), (self.doc_ids, "<i8")):
            self.out.write(np.asarray(values, dtype=kind).tobytes())
        self.out.write(bytes(self.known))
        self.out.write(TRAILER.pack(self.bits, self.block_ids, self.ids, len(self.doc_ids), self.at))


class ShardReader:
    """Random access to one shard file, which must be seekable."""

    def __init__(self, file: pa.NativeFile | BinaryIO) -> None:
        self.file = file
        file.seek(0, 2)
        end = file.tell()
        file.seek(end - TRAILER.size)
        self.bits, self.block_ids, self.ids, self.documents, at = TRAILER.unpack(file.read(TRAILER.size))
        blocks = -(-self.ids // self.block_ids)
        file.seek(at)
        self.offsets = np.frombuffer(file.read(8 * (blocks + 1)), dtype="<u8")
        self.starts = np.frombuffer(file.read(8 * (self.documents + 1)), dtype="<u8").astype(np.int64)
        self.doc_ids = np.frombuffer(file.read(8 * self.documents), dtype="<i8")
        self.known = np.frombuffer(file.read(self.documents), dtype=np.uint8).astype(bool)

    def read(self, start: int, end: int) -> np.ndarray:
        """Ids ``start`` up to ``end`` of the file, from the blocks that hold them."""
        if end <= start:
            return np.zeros(0, dtype="<u4")
        first, last = start // self.block_ids, (end - 1) // self.block_ids
        self.file.seek(int(self.offsets[first]))
        data, base = self.file.read(int(self.offsets[last + 1] - self.offsets[first])), int(self.offsets[first])
        parts = [
            unpack(data[int(self.offsets[b]) - base : int(self.offsets[b + 1]) - base], self.bits, min(self.block_ids, self.ids - b * self.block_ids))
            for b in range(first, last + 1)
        ]
        return np.concatenate(parts)[start - first * self.block_ids : end - first * self.block_ids]

    def document(self, place: int) -> np.ndarray:
        """The ids of the document at ``place``, its end id included."""
        return self.read(int(self.starts[place]), int(self.starts[place + 1]))

    def each(self, most_ids: int = 1 << 20) -> Iterator[tuple[int, np.ndarray]]:
        """Every document's place and ids in turn, read in runs of about ``most_ids``."""
        place = 0
        while place < self.documents:
            stop = max(place + 1, int(np.searchsorted(self.starts, self.starts[place] + most_ids, side="right")) - 1)
            base, ids = int(self.starts[place]), self.read(int(self.starts[place]), int(self.starts[stop]))
            for i in range(place, stop):
                yield i, ids[int(self.starts[i]) - base : int(self.starts[i + 1]) - base]
            place = stop


class PieceEncoder:
    """A byte-level tokenizer with a memory of frequent words, kept for the worker's life.

    The tokenizer never joins what stands before a single space with what follows it, and how it splits before the
    space doesn't depend on the other side. So a text whose spaces touch no other white space is the sequence of its
    first word and of its other words with a space before each; most have been met before. New words go to the
    tokenizer as one text: each begins at a token that begins with the space, and has no other such token. Any other
    text is given to it whole, and so is one in which a special token is named, which the tokenizer takes for the token.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        named = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.marks = re.compile("|".join(map(re.escape, named)) if named else r"(?!)")
        self.tokenize = self.tokenizer.model.tokenize
        self.space = space = self.tokenizer.encode(" ", add_special_tokens=False).tokens[0]
        self.spaced = np.zeros(self.tokenizer.get_vocab_size(), dtype=bool)
        self.spaced[[i for token, i in self.tokenizer.get_vocab().items() if token.startswith(space)]] = True
        self.closing = {mark: ids for mark, ids in zip(CLOSING, self._batch(list(CLOSING)))}
        self.recent: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _batch(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _spaced(self, words: list[str], often: np.ndarray) -> list[bytes]:
        """The ids of each word with a space before it; those met ``often`` are remembered.

        The tokenizer splits after a letter or digit that a full stop or comma follows, so a word's ids are those
        of the word without such a mark at its end and the mark's own.
        """
        if len(self.recent) > MEMO_WORDS:
            self.recent, self.older = {}, self.recent
        recent, older = self.recent, self.older
        pieces = list(map(recent.get, words))
        fresh: dict[str, int] = {}  # new words without their closing mark, and where each is met first
        again, marked = [], []
        for i, piece in enumerate(pieces):
            if piece is None:
                word, mark = words[i], b""
                if word[-1:] in self.closing and word[-2:-1].isascii() and word[-2:-1].isalnum():
                    word, mark = word[:-1], self.closing[word[-1]]
                    if (piece := recent.get(word)) is not None:
                        pieces[i] = piece + mark
                        continue
                if (piece := older.get(word)) is not None:
                    recent[word] = piece
                    pieces[i] = piece + mark
                    continue
                first = fresh.setdefault(word, i)
                if first != i:
                    often[first] = True
                    again.append((i, first))
                if mark:
                    marked.append((i, mark))
        new = []
        for word, i in fresh.items():
            if word.isascii() and word.isalpha():
                piece = pieces[i] = array("I", [token.id for token in self.tokenize(self.space + word)]).tobytes()
                if often[i]:
                    recent[word] = piece
            else:
                new.append((word, i))
        for start in range(0, len(new), FRESH_WORDS):
            own = new[start : start + FRESH_WORDS]
            data = self._batch([" " + " ".join([word for word, _ in own])])[0]
            starts = (4 * np.flatnonzero(self.spaced[np.frombuffer(data, dtype="<u4")])).tolist()
            starts.append(len(data))
            for (word, i), a, b in zip(own, starts[:-1], starts[1:], strict=True):
                pieces[i] = data[a:b]
                if often[i]:
                    recent[word] = pieces[i]
        for i, first in again:
            pieces[i] = pieces[first]
        for i, mark in marked:
            pieces[i] += mark
        return pieces

    def _edges(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which words begin with white space, which end with it (an empty one does both), and which name a special token."""
        opens, closes, named = (np.zeros(len(words), dtype=bool) for _ in range(3))
        long = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        bare = np.fromiter(map(len, map(str.strip, words)), dtype=np.int64, count=len(words))
        for i in np.flatnonzero((long != bare) | (long == 0)).tolist():
            opens[i], closes[i] = not words[i] or words[i][0].isspace(), not words[i] or words[i][-1].isspace()
        named[[i for i, found in enumerate(map(self.marks.search, words)) if found]] = True
        return opens, closes, named

    def encode(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """In runs of whole texts, in order: all ids end to end, and where each text's ids begin and end; as the
        tokenizer gives them for whole texts."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if not len(texts):
            return
        lists = pc.split_pattern(texts, " ")
        bounds = lists.offsets.to_numpy().astype(np.int64)
        coded = lists.flatten().dictionary_encode()
        del lists
        place, words = coded.indices.to_numpy(), coded.dictionary.to_pylist()
        del coded
        bounds = bounds - bounds[0]
        first, last = bounds[:-1], bounds[1:] - 1

        opens, closes, named = self._edges(words)
        opens, closes = opens[place], closes[place]
        opens[first] = False
        closes[last] = False
        opens |= closes
        if named.any():
            opens |= named[place]
        whole = np.logical_or.reduceat(opens, first)
        del opens, closes

        later = np.ones(len(place), dtype=bool)
        later[first] = False
        later &= ~np.repeat(whole, np.diff(bounds))
        times = np.bincount(place[later], minlength=len(words))
        used = np.flatnonzero(times)
        pieces = self._spaced([words[i] for i in used], times[used] > 1)
        slot = np.zeros(len(words), dtype=np.int32)
        slot[used] = np.arange(len(used))
        heads = sorted({words[i] for i in place[first[~whole]]})
        slots = {w: len(pieces) + k for k, w in enumerate(heads)}
        pieces += self._batch(heads)
        opening = [slots.get(words[i], 0) for i in place[first]]
        place = slot[place]
        place[first] = opening
        del words
        sizes = np.fromiter(map(len, pieces), dtype=np.int32, count=len(pieces)) // 4
        begins = (np.cumsum(sizes) - sizes).astype(np.int32)
        flat = np.frombuffer(b"".join(pieces), dtype="<u4")
        del pieces

        text = 0
        while text < len(texts):
            if whole[text]:
                ids = np.frombuffer(self._batch([texts[text].as_py()])[0], dtype="<u4")
                yield ids, np.array([0, len(ids)], dtype=np.int64)
                text += 1
                continue
            stop = text + 1
            while stop < len(texts) and not whole[stop] and bounds[stop + 1] - bounds[text] <= RUN_WORDS:
                stop += 1
            own = place[bounds[text] : bounds[stop]]
            lengths = sizes[own]
            ends = np.cumsum(lengths, dtype=np.int64)
            ids = flat[np.arange(ends[-1], dtype=np.int32) + np.repeat(begins[own] - (ends - lengths).astype(np.int32), lengths)]
            yield ids, np.concatenate([[0], ends])[bounds[text : stop + 1] - bounds[text]]
            text = stop


@functools.cache
def piece_encoder(path: str) -> PieceEncoder:
    return PieceEncoder(path)


def open_folder(folder: str) -> tuple[pafs.FileSystem, str]:
    """The file system of ``folder``, a URI or an absolute path, and the path in it."""
    return pafs.FileSystem.from_uri(folder)


_SHARD = "shard int, path string, documents long, ids long"


def _write(folder: str, tokenizer: str, bits: int, block_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, out, writer = TaskContext.get().partitionId(), None, None
        files, base = open_folder(folder)
        name = f"{base}/shard-{shard:06d}-{uuid.uuid4().hex}.pack"
        for part in text_runs(batches, "text", RUN_BYTES):
            if writer is None:
                out = files.open_output_stream(name)
                writer = ShardWriter(out, bits, block_ids)
            doc_ids = iter(part.column(0).to_pylist())
            for ids, bounds in piece_encoder(tokenizer).encode(part.column(1)):
                ended, starts = np.insert(ids, bounds[1:], END_ID), bounds + np.arange(len(bounds))
                for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
                    writer.add(next(doc_ids), ended[a:b])
        if writer is not None:
            writer.close()
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([name]), pa.array([len(writer.doc_ids)], pa.int64()), pa.array([writer.ids], pa.int64())], ["shard", "path", "documents", "ids"])

    return run


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, *, vocabulary: int, id_col: str = "doc_id", text_col: str = "text", block_ids: int = BLOCK_IDS) -> list[dict]:
    """Encode ``docs`` and write shard files and ``manifest.json`` to ``folder``, which tasks and driver share.

    Returns the manifest's shards in order: path, documents, ids, and ``start``, the ids of all shards before. The
    driver gathers one row per shard. Documents are in ascending id order, nulls last; repeated ids are in the order of
    their texts. A null text is empty and holds the end id alone. An empty table writes an empty manifest.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    order = [F.col("doc_id").asc_nulls_last(), F.col("text").asc_nulls_first()]
    dealt = rows.repartitionByRange(order[0], F.xxhash64("text")).sortWithinPartitions(*order)
    files, base = open_folder(folder)
    files.create_dir(base)
    shards, start = [], 0
    small_batches(dealt.sparkSession)
    for row in sorted(dealt.mapInArrow(frugal(_write(folder, tokenizer, bits_for(vocabulary), block_ids)), _SHARD).collect()):
        shards.append({"path": row.path, "documents": row.documents, "ids": row.ids, "start": start})
        start += row.ids
    with files.open_output_stream(f"{base}/manifest.json") as out:
        out.write(json.dumps({"bits": bits_for(vocabulary), "block_ids": block_ids, "ids": start, "shards": shards}).encode())
    return shards


def _read(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, _ = open_folder(folder)
        for batch in batches:
            for shard in batch.to_pylist():
                with files.open_input_file(shard["path"]) as file:
                    reader = ShardReader(file)
                    sums = np.array([zlib.crc32(ids) for _, ids in reader.each()], dtype=np.int64)
                doc_ids = pa.array(reader.doc_ids, pa.int64(), mask=~reader.known)
                yield pa.RecordBatch.from_arrays([doc_ids, pa.array(reader.starts[:-1] + shard["start"]), pa.array(np.diff(reader.starts)), pa.array(sums)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return run


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from the files that ``folder``'s manifest names.

    ``start`` counts the ids of all documents before; the checksum is over the ids as little-endian 32-bit integers.
    """
    files, base = open_folder(folder)
    with files.open_input_stream(f"{base}/manifest.json") as file:
        shards = json.loads(file.read())["shards"]
    rows = [(i, s["path"], s["start"]) for i, s in enumerate(shards)]
    listed = spark.createDataFrame(rows, "shard int, path string, start long").repartitionById(max(1, len(rows)), F.col("shard"))
    return listed.mapInArrow(frugal(_read(folder)), "doc_id long, start long, n_tokens long, ids_crc32 long")
