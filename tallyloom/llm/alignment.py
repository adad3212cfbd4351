"""Cross-tokenizer alignment: which tokens of two vocabularies cover the same bytes, and how often over the corpus.

Both vocabularies encode a text with a space before it. The ends of each one's tokens are set bits over the bytes,
packed in 64-bit words. The AND of both bitsets holds the cuts that they share, which part the text into groups; their
OR parts it into the pieces that one token of each covers, the links. A popcount index (rank) tells how many tokens end
before a byte, so a cut maps to a range of tokens and a piece to its two tokens.

No vocabulary joins what stands before a space with what follows it, so a text whose spaces touch no other white space
is the sequence of its words with a space before each: such a unit is encoded and aligned once and remembered. Any other
text is one unit.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.common import cut, frugal, small_batches, text_runs
from tallyloom.operators.skew import join_uneven

#: Bytes of text that are aligned together (a longer text stands alone), and bytes of new units that are.
RUN_BYTES, FRESH_BYTES = 2 << 20, 1 << 18
#: Words, some 300 bytes each, after which a worker forgets the rare ones.
MEMO_UNITS = 200_000
#: Id pairs up to which their counts are sent to every worker, 17 bytes each; beyond, links are joined to them.
BROADCAST_PAIRS = 3_000_000
#: Distinct pairs that a task counts before it passes them on.
HELD_PAIRS = 1 << 20
#: A pair is the first id times this, and the second: no vocabulary has as many ids.
BASE = 1 << 31
#: Begins a piece that stands for a single byte, as in <0x0A>; and what stands for a space in a piece.
BYTE_PIECE, PIECE_SPACE = "<0x", "▁"


class Bits:
    """Set positions among ``size``, as packed words with the popcount of all words before each."""

    def __init__(self, words: np.ndarray) -> None:
        self.words = words
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])

    @classmethod
    def of(cls, places: np.ndarray, size: int) -> Bits:
        flags = np.zeros(-(-max(1, size) // 64) * 64, dtype=np.uint8)
        flags[places] = 1
        return cls(np.packbits(flags, bitorder="little").view("<u8"))

    def rank(self, places: np.ndarray) -> np.ndarray:
        """How many set positions come before each of ``places``."""
        word, bit = places >> 6, (places & 63).astype(np.uint64)
        whole = word >= len(self.words)
        low = self.words[np.where(whole, 0, word)] & ((np.uint64(1) << bit) - np.uint64(1))
        return self.before[word] + np.where(whole, 0, np.bitwise_count(low)).astype(np.int64)

    def select(self) -> np.ndarray:
        """All set positions, ascending."""
        return np.flatnonzero(np.unpackbits(self.words.view(np.uint8), bitorder="little"))

    def __and__(self, other: Bits) -> Bits:
        return Bits(self.words & other.words)

    def __or__(self, other: Bits) -> Bits:
        return Bits(self.words | other.words)


def _byte_level() -> dict[str, int]:
    """The byte that each character of a byte-level token stands for: printable ones for themselves, others from 256 on."""
    kept = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in kept]
    return {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Bytes of every id, end to end, and the ids in decimal."""

    def __init__(self, tokens: list[bytes]) -> None:
        self.flat = np.frombuffer(b"".join(tokens), dtype=np.uint8)
        self.sizes = np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens))
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.spaced = np.fromiter((t[:1] == b" " for t in tokens), dtype=bool, count=len(tokens))
        self.decimal = [b"%d" % i for i in range(len(tokens))]

    def spelled(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of ``ids`` end to end, and where each ends."""
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        return self.flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts[ids] - (ends - sizes), sizes)], ends


class ByteTokens:
    """A byte-level vocabulary of the tokenizers library; the names of special tokens are plain text."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        byte, names = _byte_level(), self.tokenizer.get_vocab()
        tokens = [b""] * (max(names.values()) + 1)
        for name, i in names.items():
            tokens[i] = bytes(byte[c] for c in name) if all(c in byte for c in name) else name.encode()
        self.vocabulary = Vocabulary(tokens)

    def encode(self, text: str) -> np.ndarray:
        return np.asarray(self.tokenizer.encode_batch_fast([f" {text}"], add_special_tokens=False)[0].ids, dtype=np.int64)


class PieceTokens:
    """A vocabulary of the sentencepiece library, which puts the space before a text itself."""

    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor

        self.pieces = SentencePieceProcessor(model_file=path)
        names = map(self.pieces.id_to_piece, range(self.pieces.get_piece_size()))
        single = self.pieces.is_byte
        tokens = [bytes([int(n[len(BYTE_PIECE) : -1], 16)]) if single(i) else n.replace(PIECE_SPACE, " ").encode() for i, n in enumerate(names)]
        self.vocabulary = Vocabulary(tokens)

    def encode(self, text: str) -> np.ndarray:
        return np.asarray(self.pieces.encode(text, num_threads=1), dtype=np.int64)


def _written(ids: list[list[bytes]], ends: list[np.ndarray]) -> list[bytes]:
    """Every group as ``a1,a2|b1``, for the ids in decimal and the ranks at which groups end."""
    (a, b), (to_a, to_b) = ids, (e.tolist() for e in ends)
    out, i, j = [], 0, 0
    for p, q in zip(to_a, to_b, strict=True):
        out.append(b"%b|%b" % (a[i], b[j]) if p - i == 1 == q - j else b",".join(a[i:p]) + b"|" + b",".join(b[j:q]))
        i, j = p, q
    return out


@dataclass
class Aligned:
    """What is known of some units, by column. A unit that not both vocabularies spell has no tokens and isn't sound."""

    sound: np.ndarray
    numbers: np.ndarray  # tokens of A and of B, groups, links
    groups: list[bytes]
    pairs: np.ndarray  # of all links end to end

    @classmethod
    def none(cls, units: int) -> Aligned:
        return cls(np.zeros(units, dtype=bool), np.zeros((units, 4), dtype=np.int64), [b""] * units, np.zeros(0, dtype=np.int64))

    def chosen(self, units: np.ndarray) -> Aligned:
        links = np.zeros(len(self.sound), dtype=bool)
        links[units] = True
        return Aligned(self.sound[units], self.numbers[units], [self.groups[i] for i in units.tolist()], self.pairs[np.repeat(links, self.numbers[:, 3])])

    def followed(self, others: list[Aligned]) -> Aligned:
        every = [self, *others]
        return Aligned(*(np.concatenate([getattr(x, name) for x in every]) for name in ("sound", "numbers")), [g for x in every for g in x.groups], np.concatenate([x.pairs for x in every]))


class Aligner:
    """Aligns units, with a memory of them that a worker keeps until it is full."""

    def __init__(self, byte_path: str, piece_path: str) -> None:
        self.first, self.second = ByteTokens(byte_path), PieceTokens(piece_path)
        self.index: dict[str, int] = {}
        self.uses = np.zeros(0, dtype=np.int64)
        self.known = Aligned.none(0)

    def _forget(self) -> None:
        """Keep the words that came more than once, and of these the more frequent ones up to half of the memory."""
        least = 2
        while (kept := np.flatnonzero(self.uses >= least)).size > MEMO_UNITS // 2:
            least *= 2
        words = list(self.index)
        self.index = {words[i]: k for k, i in enumerate(kept.tolist())}
        self.uses, self.known = self.uses[kept] // 2, self.known.chosen(kept)

    def _encoded(self, tokens: ByteTokens | PieceTokens, words: list[str], texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all units end to end, and where each begins: the words go to the tokenizer as one text, in which a
        token that begins with the space begins a word."""
        runs = [tokens.encode(" ".join(words))] if words else []
        begins = [np.flatnonzero(tokens.vocabulary.spaced[run]) for run in runs]
        at = sum(map(len, runs))
        for text in texts:
            runs.append(tokens.encode(text))
            begins.append(np.array([at]))
            at += len(runs[-1])
        return np.concatenate(runs), np.concatenate(begins)

    def _align(self, words: list[str], texts: list[str]) -> Aligned:
        """Align ``words`` and ``texts``, each with a space before it, as one sequence of bytes."""
        own = [f" {u}".encode() for u in itertools.chain(words, texts)]
        sizes = np.fromiter(map(len, own), dtype=np.int64, count=len(own))
        flat = np.frombuffer(b"".join(own), dtype=np.uint8)
        coded, sound = [], np.ones(len(own), dtype=bool)
        for tokens in (self.first, self.second):
            ids, begins = self._encoded(tokens, words, texts)
            coded.append((ids, begins, np.diff(begins, append=len(ids))))
            sound &= np.add.reduceat(tokens.vocabulary.sizes[ids], begins) == sizes
        for tokens, (ids, _, long) in zip((self.first, self.second), coded, strict=True):
            differs = tokens.vocabulary.spelled(ids[np.repeat(sound, long)])[0] != flat[np.repeat(sound, sizes)]
            if differs.any():
                sound[np.unique(np.repeat(np.flatnonzero(sound), sizes[sound])[differs])] = False
        out = Aligned.none(len(own))
        if not sound.any():
            return out
        a, b = (ids[np.repeat(sound, long)] for ids, _, long in coded)
        ends_a, ends_b = np.cumsum(self.first.vocabulary.sizes[a]), np.cumsum(self.second.vocabulary.sizes[b])
        size = int(ends_a[-1])
        bits_a, bits_b = Bits.of(ends_a - 1, size), Bits.of(ends_b - 1, size)
        shared, either = bits_a & bits_b, bits_a | bits_b
        # the bit of a token's last byte is set: up to a cut, all tokens that end there or before; before it, a piece's own
        cuts, pieces = shared.select(), either.select()
        groups = _written([[v.decimal[i] for i in ids.tolist()] for v, ids in ((self.first.vocabulary, a), (self.second.vocabulary, b))], [bits_a.rank(cuts + 1), bits_b.rank(cuts + 1)])
        out.sound = sound
        out.pairs = a[bits_a.rank(pieces)] * BASE + b[bits_b.rank(pieces)]
        to = np.cumsum(sizes[sound])  # a unit ends at a cut of both
        out.numbers[sound] = np.stack([np.diff(found.rank(to), prepend=0) for found in (bits_a, bits_b, shared, either)], axis=1)
        at = 0
        for unit, n in zip(np.flatnonzero(sound).tolist(), out.numbers[sound, 2].tolist(), strict=True):
            out.groups[unit] = groups[at] if n == 1 else b";".join(groups[at : at + n])
            at += n
        return out

    def units(self, words: list[str], texts: list[str]) -> tuple[Aligned, np.ndarray]:
        """What is known of ``words`` and then ``texts``, which aren't remembered: a table and the row of each in it.

        The table holds until the next call.
        """
        if len(self.index) > MEMO_UNITS:
            self._forget()
        rows = list(map(self.index.get, words))
        fresh = [i for i, row in enumerate(rows) if row is None]
        new, start, size = [], 0, 0
        for end, i in enumerate(fresh, 1):
            rows[i] = self.index[words[i]] = len(self.index)
            size += len(words[i])
            if size >= FRESH_BYTES or end == len(fresh):
                new.append(self._marked([words[j] for j in fresh[start:end]]))
                start, size = end, 0
        if new:
            self.known = self.known.followed(new)
        self.uses = np.concatenate([self.uses, np.zeros(len(self.index) - len(self.uses), dtype=np.int64)])
        self.uses[rows] += 1
        if not texts:
            return self.known, np.array(rows, dtype=np.int64)
        base = len(self.known.sound)
        found = self.known.followed([self._align([], [t]) if PIECE_SPACE not in t else Aligned.none(1) for t in texts])
        return found, np.array([*rows, *range(base, base + len(texts))], dtype=np.int64)

    def _marked(self, words: list[str]) -> Aligned:
        """Align ``words``; those that hold the character for a space are none of B's."""
        marked = [PIECE_SPACE in w for w in words]
        if not any(marked):
            return self._align(words, [])
        kept = [w for w, m in zip(words, marked, strict=True) if not m]
        found, out = self._align(kept, []) if kept else Aligned.none(0), Aligned.none(len(words))
        at = np.flatnonzero(~np.array(marked))
        out.sound[at], out.numbers[at], out.pairs = found.sound, found.numbers, found.pairs
        for i, group in zip(at.tolist(), found.groups, strict=True):
            out.groups[i] = group
        return out


@functools.cache
def aligner(byte_path: str, piece_path: str) -> Aligner:
    return Aligner(byte_path, piece_path)


def _cut_up(texts: pa.Array) -> tuple[list[str], list[str], np.ndarray, np.ndarray]:
    """Distinct words; the texts that are no sequence of words; which word, or text after all words, each place holds; and
    where each text's places begin and end. Empty texts have none."""
    lists = pc.split_pattern(pc.fill_null(texts.cast(pa.large_string()), ""), " ")
    bounds = lists.offsets.to_numpy().astype(np.int64)
    bounds -= bounds[0]
    coded = lists.flatten().dictionary_encode()
    words, place = coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64)
    long, bare = (np.fromiter(map(len, x), dtype=np.int64, count=len(words)) for x in (words, map(str.strip, words)))
    rough = (long != bare) | (long == 0)
    if not rough.any():
        return words, [], place, bounds
    whole = np.logical_or.reduceat(rough[place], bounds[:-1])
    used, place_of = np.unique(place[np.repeat(~whole, np.diff(bounds))], return_inverse=True)
    wholes = [texts[i].as_py() for i in np.flatnonzero(whole).tolist()]
    held = [bool(t) for t in wholes]
    lengths = np.diff(bounds)
    lengths[whole] = held
    out = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum(lengths, out=out[1:])
    filled = np.zeros(out[-1], dtype=np.int64)
    at = np.repeat(whole, lengths)
    filled[~at] = place_of
    filled[at] = len(used) + np.arange(sum(held))
    return [words[i] for i in used.tolist()], [t for t in wholes if t], filled, out


def _packed(codes: np.ndarray, counts: np.ndarray) -> bytes:
    """Ascending pairs and their counts in few bytes: differences, compressed."""
    raw = np.stack([np.diff(codes, prepend=0), counts]).astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes()
    return np.int64(len(codes)).tobytes() + pa.compress(raw, codec="lz4", asbytes=True)


def _unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int(np.frombuffer(data, dtype="<i8", count=1)[0])
    raw = np.frombuffer(pa.decompress(data[8:], decompressed_size=16 * n, codec="lz4", asbytes=True), dtype=np.uint8)
    steps, counts = np.ascontiguousarray(raw.reshape(8, 2 * n).T).view("<i8").reshape(2, n)
    return np.cumsum(steps), counts


def _aligned(byte_path: str, piece_path: str):
    names = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "groups", "pairs"]

    def run(batches: Iterator[pa.RecordBatch], keep_groups: bool) -> Iterator[pa.RecordBatch]:
        known, row = aligner(byte_path, piece_path), TaskContext.get().partitionId() << 33
        for part in text_runs(batches, "text", RUN_BYTES):
            words, texts, place, bounds = _cut_up(part.column(1))
            found, rows = known.units(words, texts)
            place = rows[place]
            starts = np.cumsum(found.numbers[:, 3]) - found.numbers[:, 3]
            written, checksums, pairs, totals = [], [], [], np.zeros((part.num_rows, 4), dtype=np.int64)
            for i in range(part.num_rows):
                own = place[bounds[i] : bounds[i + 1]]
                if not len(own) or not found.sound[own].all():
                    own = own[:0]
                totals[i] = found.numbers[own].sum(axis=0)
                groups = b";".join([found.groups[u] for u in own.tolist()])
                checksums.append(hashlib.sha256(groups).hexdigest() if len(own) else "")
                written.append(groups.decode() if keep_groups else None)
                pairs.append(_packed(*_tallied(found, starts, own)))
            columns = [pa.array(np.arange(row, row + part.num_rows)), part.column(0), *map(pa.array, totals.T), pa.array(checksums, pa.string()), pa.array(written, pa.string()), pa.array(pairs, pa.binary())]
            row += part.num_rows
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def _tallied(found: Aligned, starts: np.ndarray, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of all links of ``units``, ascending, and how many links have each."""
    sizes = found.numbers[units, 3]
    ends = np.cumsum(sizes)
    codes = np.sort(found.pairs[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts[units] - (ends - sizes), sizes)])
    first = np.flatnonzero(np.diff(codes, prepend=-1))
    return codes[first], np.diff(first, append=len(codes))


_DIGEST = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, groups string, pairs binary"


def _pair_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every pair and its links in the rows of a task; a pair may come more than once."""

    def told(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        codes, which = np.unique(np.concatenate([c for c, _ in held]), return_inverse=True)
        counts = np.zeros(len(codes), dtype=np.int64)
        np.add.at(counts, which, np.concatenate([n for _, n in held]))
        return codes, counts

    def rows(found: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["pair", "n"])

    held, size, least = [], 0, HELD_PAIRS // 4
    for batch in batches:
        for data in batch.column(0).to_pylist():
            held.append(_unpacked(data))
            size += len(held[-1][0])
            if size >= 2 * least:
                held = [told(held)]
                size = least = max(HELD_PAIRS // 4, len(held[0][0]))
                if size >= HELD_PAIRS:
                    yield rows(held[0])
                    held, size, least = [], 0, HELD_PAIRS // 4
    if held:
        yield rows(told(held))


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs of every row, one by one."""
    for batch in batches:
        for row, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            codes, counts = _unpacked(data)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(codes), row)), pa.array(codes), pa.array(counts)], ["row", "pair", "n"])


def _summed(sent):
    """Each row's links whose count is their second id's highest, and the counts of all its links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, counts, best = (np.frombuffer(x, dtype=kind) for x, kind in zip(sent.value, ("<i8", "<i8", "?"), strict=True))
        for batch in batches:
            n_best, count_sum = [], []
            for data in batch.column("pairs").to_pylist():
                codes, own = _unpacked(data)
                at = np.searchsorted(pairs, codes)
                n_best.append(int(own[best[at]].sum()))
                count_sum.append(int((own * counts[at]).sum()))
            kept = [n for n in batch.schema.names if n != "pairs"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), pa.array(n_best, pa.int64()), pa.array(count_sum, pa.int64())], [*kept, "n_best", "count_sum"])

    return run


def align(docs: DataFrame, byte_path: str, piece_path: str, *, id_col: str = "doc_id", text_col: str = "text", keep_groups: bool = False) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum`` of every row of ``docs``; see the module.

    ``keep_groups`` adds ``groups``, the groups themselves. Tokens of ``byte_path`` are A, those of ``piece_path`` B. A
    pair's count is the number of links over all rows; ``n_best`` counts a row's links whose pair is the most frequent
    of its B id, ties included; ``count_sum`` sums the counts over its links.

    Null and empty texts, and those that A's or B's tokens don't spell (as where the text holds the character that
    stands for a space), have no tokens: zeros and an empty string. Repeated rows and ids are rows of their own and count
    anew; a null id stays null. Other columns aren't read, so their names can't clash. An empty table gives no rows. A
    very long text is aligned whole in one task, with some hundred bytes for each of its tokens.

    Rows keep their pairs (about a third of the text's bytes) in the checkpoint folder. The counts are grouped by pair,
    after each task has added up its own. Up to ``BROADCAST_PAIRS`` they go to all workers, beyond that links are joined.
    """
    spark = docs.sparkSession
    small_batches(spark)
    run = _aligned(byte_path, piece_path)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    digest = cut(rows.mapInArrow(frugal(lambda batches: run(batches, keep_groups)), _DIGEST))
    kept = [c for c in digest.columns if c not in ("row", "pairs") and (keep_groups or c != "groups")]

    found = digest.select("pairs").mapInArrow(frugal(_pair_counts), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    found = cut(found.withColumn("b", F.col("pair") % BASE))
    highest = found.groupBy("b").agg(F.max("n").alias("most"))  # a B id has as many rows as A has ids at most
    counted = found.join(highest, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))
    if counted.limit(BROADCAST_PAIRS + 1).count() <= BROADCAST_PAIRS:
        sent = _send(spark, counted)
        out = ", ".join(f"{n} {t}" for n, t in digest.select(*kept).dtypes)
        return digest.select(*kept, "pairs").mapInArrow(frugal(_summed(sent)), f"{out}, n_best long, count_sum long".replace("bigint", "long"))

    links = digest.select("row", "pairs").mapInArrow(frugal(_listed), "row long, pair long, n long")
    held = counted.withColumnRenamed("n", "count").join(links.groupBy("pair").agg(F.count("*").alias("held")), "pair")
    total = held.agg(F.sum("held")).first()[0] or 0
    per_row = join_uneven(links, held, "pair", "held", total).groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("count")).alias("count_sum"))
    zero = F.lit(0).cast("long")
    return digest.join(per_row, "row", "left").select(*kept, F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"))


def _send(spark: SparkSession, counted: DataFrame):
    """The counts, ascending by pair, for every worker: at most ``BROADCAST_PAIRS`` rows through the driver, as arrays."""
    table = counted.toArrow()
    pairs, counts, best = (table.column(n).to_numpy() for n in ("pair", "n", "best"))
    order = np.argsort(pairs, kind="stable")
    return spark.sparkContext.broadcast((pairs[order].astype("<i8").tobytes(), counts[order].astype("<i8").tobytes(), best[order].astype("?").tobytes()))
