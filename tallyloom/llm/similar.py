"""Near duplicates by word shingles through wide SimHash fingerprints, a byte-position inverted index and verification.

At a similarity of 0.8 some 15 of 100 fingerprint bits differ, so no number of equal bytes is guaranteed by counting
bits. The index posts wide fingerprints (four 64-bit ones, 32 positional bytes) under ``TRIPLES`` of three positional
bytes and finds most similar pairs; each list's members meet its busiest member, which in a group of copies is the
original, and pairs within ``MOST_BITS`` are verified by the exact similarity of their shingle sets.

What the index misses an exact pass finds: similar texts share a shingle in the prefixes of their sets, ordered by the
number of texts that hold each shingle. Pairs of different components that meet there are verified in the same way.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.llm.common import broadcast_within, cut, frugal, small_batches, split_words, text_slices
from tallyloom.llm.components import by_size, connected_components
from tallyloom.llm.simhash import CHUNK, SEED
from tallyloom.operators.skew import join_salted, join_uneven

SHINGLE_WORDS = 5
SIMILARITY = 0.8
#: 64-bit words of a wide fingerprint, the triples of its bytes that are posted, and what similar documents keep to.
WORDS, TRIPLES, LEAST_SHARED_BYTES, MOST_BITS = 4, 48, 3, 64
#: Texts whose hashes are broadcast to fetch them (some 16 bytes each); more are joined.
BROADCAST_TEXTS = 500_000
#: Shingles that are counted together (of some six characters each), and members of a list that are paired in one block.
SHINGLES_PER_PART, LIST_BLOCK = 1 << 20, 1024
_F = [f"f{i}" for i in range(WORDS)]


def shingle_hashes(text: str | None, shingle_words: int = SHINGLE_WORDS) -> np.ndarray:
    """The distinct hashes of the text's shingles of words in lower case (A-Z), sorted; the whole text's if it has fewer words."""
    words = [w.lower() for w in split_words(text)]
    if not words:
        return np.zeros(0, dtype=np.uint64)
    count = max(1, len(words) - shingle_words + 1)
    shingles = map(b" ".join, zip(*(words[i:] for i in range(shingle_words)))) if len(words) >= shingle_words else [b" ".join(words)]
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), dtype=np.uint64, count=count))


def wide_fingerprint(hashes: np.ndarray) -> np.ndarray:
    """The fingerprint's words from distinct shingle hashes; each word's bits are votes of the hashes mixed anew."""
    out = np.zeros(WORDS, dtype=np.uint64)
    for k in range(WORDS if len(hashes) else 0):
        votes = np.zeros(64, dtype=np.int64)
        for start in range(0, len(hashes), CHUNK):
            h = hashes[start : start + CHUNK] * np.uint64(0x9E3779B97F4A7C15 + 0x632BE59BD9B4E01A * k & (1 << 64) - 1)
            h ^= h >> np.uint64(32)
            h *= np.uint64(0xFF51AFD7ED558CCD)
            h ^= h >> np.uint64(29)
            votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[k] = np.packbits(votes * 2 > len(hashes), bitorder="little").view("<u8")[0]
    return out


def similarity_of(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sets of hashes; 1 for two empty ones."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared / (len(a) + len(b) - shared)


@lru_cache(maxsize=1)
def byte_triples() -> list[tuple[int, int, int]]:
    """Triples of byte positions, chosen one by one so that every pair of positions is in about as many of them."""
    every = np.array(list(combinations(range(8 * WORDS), 3)))
    every = every[np.random.default_rng(SEED).permutation(len(every))]
    covered, free, out = np.zeros((8 * WORDS, 8 * WORDS), dtype=np.int64), np.ones(len(every), dtype=bool), []
    for _ in range(TRIPLES):
        load = sum(covered[every[:, i], every[:, j]] for i, j in ((0, 1), (0, 2), (1, 2)))
        best = int(np.argmin(np.where(free, load, 1 << 30)))
        free[best] = False
        a, b, c = sorted(every[best].tolist())
        covered[a, b] += 1
        covered[a, c] += 1
        covered[b, c] += 1
        out.append((a, b, c))
    return out


def _prints(shingle_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text"):
                found = np.array([wide_fingerprint(shingle_hashes(t.as_py(), shingle_words)) for t in part.column(1)], dtype=np.uint64).reshape(-1, WORDS)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), *(pa.array(np.ascontiguousarray(found[:, k]).view(np.int64)) for k in range(WORDS))], ["doc_id", "print", *_F])

    return run


def _differing(a: list[Column], b: list[Column]) -> Column:
    return reduce(lambda x, y: x + y, [F.bit_count(x.bitwiseXOR(y)) for x, y in zip(a, b)])


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    a, b, c = np.array(byte_triples(), dtype=np.int64).T
    number = np.arange(TRIPLES, dtype=np.int64) << 24
    for batch in batches:
        parts = np.stack([batch.column(k + 1).to_numpy() for k in range(WORDS)], axis=1).astype("<i8").view(np.uint8).astype(np.int64)
        keys = number + (parts[:, a] << 16) + (parts[:, b] << 8) + parts[:, c]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), TRIPLES)), pa.array(keys.ravel())], ["class", "key"])


def _similar(shingle_words: int, similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}  # of the texts met last

        def hashes(name: int, text: str | None) -> np.ndarray:
            if name not in known:
                if sum(map(len, known.values())) > CHUNK:
                    known.clear()
                known[name] = shingle_hashes(text, shingle_words)
            return known[name]

        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            near = [similarity_of(hashes(a[i], batch.column(2)[i].as_py()), hashes(b[i], batch.column(3)[i].as_py())) >= similarity for i in range(len(a))]
            kept = batch.filter(pa.array(near, pa.bool_()))
            yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1)], ["u", "v"])

    return run


def _verified(pairs: DataFrame, rows: DataFrame, shingle_words: int, similarity: float) -> DataFrame:
    """The ``pairs (u, v)`` of text hashes whose texts are similar."""
    pairs = cut(pairs)
    total = pairs.count()
    if not total:
        return pairs
    pairs = by_size(pairs, total)
    wanted, _ = broadcast_within(pairs.select(F.col("u").alias("print")).unionByName(pairs.select(F.col("v").alias("print"))).distinct(), BROADCAST_TEXTS)
    texts = cut(rows.select("print", "text").join(wanted, "print", "left_semi").dropDuplicates(["print"]))
    left = join_salted(pairs, texts.select(F.col("print").alias("u"), F.col("text").alias("a")), "u", F.xxhash64("v"), total)
    both = join_salted(left, texts.select(F.col("print").alias("v"), F.col("text").alias("b")), "v", F.xxhash64("u"), total, counted=pairs)
    return cut(both.select("u", "v", "a", "b").mapInArrow(frugal(_similar(shingle_words, similarity)), "u long, v long"))


def _links(classes: DataFrame, rows: DataFrame, shingle_words: int, similarity: float) -> DataFrame:
    """``(u, v)`` of similar classes that have all candidates' components; ``classes`` are ``(class, f0, f1, ...)``."""
    postings = classes.select("class", *_F).mapInArrow(frugal(_postings), "class long, key long").repartition("key")
    shared = postings.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    entries = cut(postings.join(shared, "key"))
    busy = entries.groupBy("class").agg(F.sum("n").alias("met"))
    entries = cut(entries.join(busy.join(classes, "class"), "class"))

    hubs = entries.groupBy("key").agg(F.max_by(F.struct(F.col("class").alias("hub"), *_F), F.struct("met", "class")).alias("h"))
    meeting = entries.join(hubs, "key").where((F.col("class") != F.col("h.hub")) & (_differing([F.col(c) for c in _F], [F.col(f"h.{c}") for c in _F]) <= MOST_BITS))
    met = cut(meeting.select(F.least("class", "h.hub").alias("u"), F.greatest("class", "h.hub").alias("v")).distinct())
    links = _verified(met, rows, shingle_words, similarity)

    return links.unionByName(_missed(links, met, rows, shingle_words, similarity))


def _packed(part: np.ndarray, *columns: np.ndarray) -> list[pa.Array]:
    """``part``'s values, each with the bytes of its rows of every column."""
    by = np.argsort(part, kind="stable")
    parts, starts = np.unique(part[by], return_index=True)
    bounds = [*starts.tolist(), len(by)]
    return [pa.array(parts.astype(np.int64)), *(pa.array([c[by[i:j]].tobytes() for i, j in zip(bounds, bounds[1:])], pa.binary()) for c in columns)]


def _unpacked(table: pa.Table, **columns: str) -> list[np.ndarray]:
    return [np.frombuffer(b"".join(table.column(c).to_pylist()), dtype=kind) for c, kind in columns.items()]


def _high_bits(values: np.ndarray, bits: int) -> np.ndarray:
    return values.view(np.uint64) >> np.uint64(64 - bits)


def _shingles(shingle_words: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text"):
                sets = [shingle_hashes(t.as_py(), shingle_words) for t in part.column(1)]
                sets = [s if len(s) else np.zeros(1, dtype=np.uint64) for s in sets]  # texts without words are alike
                sizes = np.array([len(s) for s in sets], dtype=np.int32)
                h = np.concatenate(sets)
                yield pa.RecordBatch.from_arrays(_packed(_high_bits(h, bits), np.repeat(part.column(0).to_numpy(), sizes), np.repeat(sizes, sizes), h), ["part", "print", "size", "h"])

    return run


def _counted(bits: int):
    def run(table: pa.Table) -> pa.Table:
        """The shingles that several texts hold, with the number of those texts."""
        name, size, h = _unpacked(table, print="<i8", size="<i4", h="<u8")
        by = np.lexsort((name, h))
        name, size, h = name[by], size[by], h[by]
        first = np.ones(len(h), dtype=bool)
        first[1:] = (h[1:] != h[:-1]) | (name[1:] != name[:-1])
        name, size, h = name[first], size[first], h[first]
        _, counts = np.unique(h, return_counts=True)
        n = np.repeat(counts, counts)
        own = n > 1
        return pa.Table.from_arrays(_packed(_high_bits(name[own], bits), name[own], size[own], h[own], n[own].astype(np.int64)), ["part", "print", "size", "h", "n"])

    return run


def _prefixes(similarity: float):
    def run(table: pa.Table) -> pa.Table:
        """Each text's shared shingles that are among its first, in the order of the texts that hold them; others' come before."""
        name, size, h, n = _unpacked(table, print="<i8", size="<i4", h="<u8", n="<i8")
        by = np.lexsort((h, n, name))
        name, size, h = name[by], size[by].astype(np.int64), h[by]
        _, starts, counts = np.unique(name, return_index=True, return_counts=True)
        place = np.arange(len(name)) + size - np.repeat(starts + counts, counts)
        kept = size - place >= similarity * size - 1e-9
        return pa.Table.from_arrays([pa.array(h[kept].view(np.int64)), pa.array(name[kept]), pa.array(place[kept]), pa.array(size[kept])], ["key", "print", "place", "size"])

    return run


def prefix_postings(rows: DataFrame, shingle_words: int, similarity: float) -> DataFrame:
    """``(key, print, place, size)``: every distinct text under the shingles of its prefix that other texts hold too.

    Two similar texts share a shingle in their prefixes: of the shingles in the order of the number of texts that hold
    them, the first that both hold has at least the wanted overlap from its ``place`` on, in either text.
    """
    words = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    bits = min(16, max(4, int(words // SHINGLES_PER_PART // 6).bit_length()))
    parted = rows.select("print", "text").mapInArrow(frugal(_shingles(shingle_words, bits)), "part long, print binary, size binary, h binary")
    counted = parted.groupBy("part").applyInArrow(_counted(bits), "part long, print binary, size binary, h binary, n binary")
    return counted.groupBy("part").applyInArrow(_prefixes(similarity), "key long, print long, place long, size long")


def _missed(links: DataFrame, tried: DataFrame, rows: DataFrame, shingle_words: int, similarity: float) -> DataFrame:
    """The links that the index has not met, exactly: all pairs that share a shingle of their prefixes and lie in different components.

    Each list's members meet its busiest member first, so that a group of copies is of one component when the lists are
    paired; what is of one component already isn't verified again. Of a pair the lesser text has the shingle among its
    first (1 - s) / (1 + s), which for texts that share a template and fall short of the similarity are their own
    shingles. Long lists are paired in blocks.
    """
    least = 1 + similarity
    entries = cut(prefix_postings(rows, shingle_words, similarity))
    entries = cut(entries.join(entries.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "key"))

    def enough(a: str, b: str) -> Column:
        rest = F.least(F.col(f"{a}size") - F.col(f"{a}place"), F.col(f"{b}size") - F.col(f"{b}place"))
        return rest * least >= similarity * (F.col(f"{a}size") + F.col(f"{b}size")) - 1e-9

    def mixed(links: DataFrame) -> DataFrame:
        """The entries of the lists whose texts are of several components, with their ``component``."""
        joined = connected_components(links).withColumnRenamed("node", "print")
        placed = cut(entries.join(joined, "print", "left").withColumn("component", F.coalesce("component", "print")))
        several = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low != high").select("key")
        return cut(placed.join(several, "key"))

    listed = mixed(links)
    busy = listed.groupBy("print").agg(F.sum("n").alias("met"))
    hubs = listed.join(busy, "print").groupBy("key").agg(F.max_by(F.struct("print", "place", "size", "component"), F.struct("met", "print")).alias("h"))
    meeting = listed.join(hubs, "key").where((F.col("component") != F.col("h.component")) & enough("", "h."))
    met = cut(meeting.select(F.least("print", "h.print").alias("u"), F.greatest("print", "h.print").alias("v")).distinct().join(tried, ["u", "v"], "left_anti"))
    found = _verified(met, rows, shingle_words, similarity)

    left = mixed(links.unionByName(found)).withColumn("blocks", F.ceil(F.col("n") / LIST_BLOCK).cast("int"))
    a = left.withColumn("block", F.pmod(F.xxhash64("print"), F.col("blocks")).cast("int")).alias("a")
    short = left.where(F.col("place") * least <= F.col("size") * (1 - similarity) + 1e-9)
    b = short.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).alias("b")
    ordered = F.struct("b.size", "b.print") < F.struct("a.size", "a.print")
    apart = (F.col("a.key") == F.col("b.key")) & (F.col("a.block") == F.col("b.block")) & (F.col("a.component") != F.col("b.component")) & ordered & enough("a.", "b.")
    others = a.join(b, apart).select(F.least("a.print", "b.print").alias("u"), F.greatest("a.print", "b.print").alias("v")).distinct()
    others = others.join(tried.unionByName(met), ["u", "v"], "left_anti")
    return found.unionByName(_verified(others, rows, shingle_words, similarity))


def similar_documents(docs: DataFrame, *, shingle_words: int = SHINGLE_WORDS, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, print, component, component_id``, as ``near_duplicates`` names them.

    Documents are linked if the sets of their word shingles (words in lower case, A-Z) have a Jaccard similarity of
    ``similarity`` at least. A text of fewer words is one shingle; null, empty and blank texts are alike. A null id is
    kept; a component is named by the smallest id that is not null (null if none is). Repeated rows stay. An empty
    table gives no rows; other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).withColumn("print", F.xxhash64(F.coalesce("text", F.lit(""))))
    schema = T.StructType([T.StructField("doc_id", rows.schema["doc_id"].dataType), *(T.StructField(c, T.LongType()) for c in ("print", *_F))])
    small_batches(rows.sparkSession)
    prints = cut(rows.select("doc_id", "text", "print").mapInArrow(frugal(_prints(shingle_words)), schema))
    classes = cut(prints.groupBy("print", *_F).agg(F.min("doc_id").alias("first_id"), F.count("*").alias("held")).withColumnRenamed("print", "class"))
    total = prints.count()
    links = _links(classes.select("class", *_F), rows, shingle_words, similarity)
    joined = connected_components(links).withColumnRenamed("node", "class")
    linked = classes.join(joined, "class", "left").select(F.col("class").alias("print"), "held", "first_id", F.coalesce("component", "class").alias("component"))
    named = linked.groupBy("component").agg(F.min("first_id").alias("component_id"), F.count("*").alias("members"))
    by_text = join_uneven(linked.select("print", "held", "component"), named, "component", "members", total)
    return join_uneven(prints.select("doc_id", "print"), by_text, "print", "held", total).select("doc_id", "print", "component", "component_id")
