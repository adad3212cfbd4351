"""Vector codes by product quantisation; the codebooks come from Lloyd rounds with Yinyang bounds, in whole numbers.

Vectors are cut into equal parts, each part position with a codebook of its own. A codebook's entries are clustered into
groups once. For every part a row keeps an upper bound of the distance to its entry and, per group, a lower bound of the
distance to the group's other entries. When entries have moved, the bounds drift by as much; only groups whose bound no
longer lies above the upper one are scanned. Bounds are rounded outwards and scans compare whole squared distances, so
ties are decided exactly and the codes are those of a full scan.

A round is one pass over the rows and their bounds, written to the checkpoint folder; tasks add up only the parts that
went from one entry to another, and the driver holds the codebooks and their sums.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import broadcast_within, cut, frugal, unused
from tallyloom.operators.skew import join_uneven

SCALE, PARTS, ENTRIES, ROUNDS, GROUPS = 4096, 8, 16, 6, 4
#: Rows whose distances are taken together.
SLICE_ROWS = 1 << 14
#: Labels whose summed errors are broadcast.
BROADCAST_LABELS = 10_000
#: Square roots and sums in 64-bit floats are off by less than this share.
SLACK = 2.0**-48


def largest_component(width: int) -> int:
    """Whole components up to this have squared distances over ``width`` components that 64 bits hold."""
    return math.isqrt((1 << 62) // max(1, width)) // 2


def _up(x: np.ndarray) -> np.ndarray:
    """As 32-bit floats, none of them below ``x``."""
    return np.nextafter((x * (1 + SLACK)).astype(np.float32), np.float32(np.inf))


def _down(x: np.ndarray) -> np.ndarray:
    """As 32-bit floats, none of them above ``x``."""
    return np.nextafter((x * (1 - SLACK)).astype(np.float32), np.float32(-np.inf))


def distances(rows: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances, of whole numbers, of each row to each entry."""
    apart = rows[:, None, :] - entries[None, :, :]
    return np.einsum("nkw,nkw->nk", apart, apart)


def group_entries(entries: np.ndarray, groups: int) -> np.ndarray:
    """The group of each entry: a few Lloyd rounds over the entries themselves, from evenly spaced ones."""
    if not len(entries):
        return np.zeros(0, dtype=np.int64)
    points = entries.astype(np.float64)
    centres = points[np.linspace(0, len(points) - 1, min(groups, len(points))).astype(int)]
    for _ in range(5):
        own = ((points[:, None, :] - centres[None, :, :]) ** 2).sum(axis=2).argmin(axis=1)
        centres = np.array([points[own == g].mean(axis=0) if (own == g).any() else centres[g] for g in range(len(centres))])
    return own


@dataclass
class Codebook:
    """One part position's entries, their groups, and how far each has moved in the last round."""

    entries: np.ndarray
    group: np.ndarray
    moved: np.ndarray

    @classmethod
    def of(cls, entries: np.ndarray, groups: int) -> Codebook:
        return cls(entries, group_entries(entries, groups), np.zeros(len(entries)))

    def replaced(self, entries: np.ndarray) -> Codebook:
        """The same groups with other entries."""
        return Codebook(entries, self.group, np.sqrt(((entries - self.entries).astype(np.float64) ** 2).sum(axis=1)) * (1 + SLACK))


def assign(rows: np.ndarray, code: np.ndarray, upper: np.ndarray, lower: np.ndarray, book: Codebook) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Codes and bounds of parts ``rows`` (n, width) after the codebook moved, and the distances that were taken.

    ``lower`` (n, groups) holds for each group a bound of the distances to its entries other than the row's own. A row
    is looked at if one of these isn't above ``upper``: first by the distance to its own entry, then group by group.
    """
    code = code.copy()
    drift = np.array([book.moved[book.group == g].max(initial=0.0) for g in range(lower.shape[1])])
    upper = _up(upper.astype(np.float64) + book.moved[code])
    lower = _down(lower.astype(np.float64) - drift)
    doubtful = np.flatnonzero((lower <= upper[:, None]).any(axis=1))
    taken = len(doubtful)
    if not taken:
        return code, upper, lower, 0
    before = code[doubtful]
    apart = rows[doubtful] - book.entries[before]
    first = np.einsum("nw,nw->n", apart, apart)
    upper[doubtful] = _up(np.sqrt(first.astype(np.float64)))
    scanned = lower[doubtful] <= upper[doubtful][:, None]
    best, least = before.copy(), first.copy()
    seen = {}
    for g in np.flatnonzero(scanned.any(axis=0)).tolist():
        members = np.flatnonzero(book.group == g)
        at = np.flatnonzero(scanned[:, g])
        if not len(members):
            lower[doubtful[at], g] = np.inf
            continue
        found = distances(rows[doubtful[at]], book.entries[members])
        taken += found.size
        seen[g] = (at, members, found)
        nearest = found.argmin(axis=1)  # the lowest index among ties
        own, entry = found[np.arange(len(at)), nearest], members[nearest]
        wins = (own < least[at]) | ((own == least[at]) & (entry < best[at]))
        best[at[wins]], least[at[wins]] = entry[wins], own[wins]
    for g, (at, members, found) in seen.items():
        others = np.where(members[None, :] == best[at][:, None], np.iinfo(np.int64).max, found).min(axis=1)
        lower[doubtful[at], g] = np.where(others == np.iinfo(np.int64).max, np.float32(np.inf), _down(np.sqrt(others.astype(np.float64))))
    left = np.flatnonzero(best != before)
    old = book.group[before[left]]  # a group that wasn't scanned counts the entry that was the row's own among its others
    lower[doubtful[left], old] = np.minimum(lower[doubtful[left], old], _down(np.sqrt(first[left].astype(np.float64))))
    code[doubtful] = best
    upper[doubtful] = _up(np.sqrt(least.astype(np.float64)))
    return code, upper, lower, taken


def _matrix(column: pa.Array, kind: str, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind).reshape(len(column), width)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, SLICE_ROWS):
            yield batch.slice(start, SLICE_ROWS)


def _binary(rows: np.ndarray) -> pa.Array:
    return pa.array([row.tobytes() for row in rows], pa.binary())


_STATE = "vector binary, code binary, before binary, upper binary, lower binary, taken long, own"


def _begin(parts: int, size: int):
    """Rows with whole components, and bounds that call for a scan of everything."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            n = batch.num_rows
            vectors = batch.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(n, size)
            columns = [_binary(vectors.astype("<i4")), _binary(np.zeros((n, parts), np.uint8)), _binary(np.full((n, parts), 255, np.uint8)), _binary(np.full((n, parts), np.inf, np.float32)), _binary(np.full((n, parts * GROUPS), -np.inf, np.float32))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.zeros(n, np.int64)), batch.column("own")], ["vector", "code", "before", "upper", "lower", "taken", "own"])

    return run


def _step(books: list[Codebook], first: bool):
    """One round's codes and bounds; ``before`` holds the codes until now."""
    parts, width = len(books), books[0].entries.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            n = batch.num_rows
            rows = _matrix(batch.column("vector"), "<i4", parts * width).astype(np.int64).reshape(n, parts, width)
            code, upper, lower = (_matrix(batch.column(c), k, parts * m).reshape(n, parts, m) for c, k, m in (("code", "u1", 1), ("upper", "<f4", 1), ("lower", "<f4", GROUPS)))
            after = [assign(rows[:, p], code[:, p, 0].astype(np.int64), upper[:, p, 0], lower[:, p], book) for p, book in enumerate(books)]
            codes, uppers, lowers = (np.stack([a[i] for a in after], axis=1).reshape(n, -1) for i in range(3))
            before = _binary(np.full((n, parts), 255, np.uint8)) if first else batch.column("code")
            taken = np.zeros(n, np.int64)
            if n:
                taken[0] = sum(a[3] for a in after)
            yield pa.RecordBatch.from_arrays([batch.column("vector"), _binary(codes.astype(np.uint8)), before, _binary(uppers.astype("<f4")), _binary(lowers.astype("<f4")), pa.array(taken), batch.column("own")], ["vector", "code", "before", "upper", "lower", "taken", "own"])

    return run


def _moves(parts: int, width: int, entries: int):
    """What a task's rows add to the counts and sums of entries: parts that changed leave one entry and join another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
        for batch in _slices(batches):
            n = batch.num_rows
            rows = _matrix(batch.column("vector"), "<i4", parts * width).astype(np.int64).reshape(n, parts, width)
            code, before = (_matrix(batch.column(c), "u1", parts).astype(np.int64) for c in ("code", "before"))
            for p in range(parts):
                changed = np.flatnonzero(code[:, p] != before[:, p])
                np.add.at(counts[p], code[changed, p], 1)
                np.add.at(sums[p], code[changed, p], rows[changed, p])
                gone = changed[before[changed, p] != 255]
                np.subtract.at(counts[p], before[gone, p], 1)
                np.subtract.at(sums[p], before[gone, p], rows[gone, p])
        at = np.argwhere((counts != 0) | (sums != 0).any(axis=2))
        p, e = at[:, 0], at[:, 1]
        # the count stands before the components
        values = np.concatenate([counts[p, e][:, None], sums[p, e]], axis=1)
        place = np.tile(np.arange(width + 1), len(at))
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(p, width + 1)), pa.array(np.repeat(e, width + 1)), pa.array(place), pa.array(values.ravel())], ["part", "entry", "place", "value"])

    return run


def _coded(books: list[Codebook]):
    parts, width = len(books), books[0].entries.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            n = batch.num_rows
            rows = _matrix(batch.column("vector"), "<i4", parts * width).astype(np.int64).reshape(n, parts, width)
            code = _matrix(batch.column("code"), "u1", parts)
            apart = rows - np.stack([b.entries[code[:, p]] for p, b in enumerate(books)], axis=1)
            yield pa.RecordBatch.from_arrays([pa.array([c.tobytes().hex() for c in code], pa.string()), pa.array(np.einsum("npw,npw->n", apart, apart)), batch.column("own")], ["code", "error", "own"])

    return run


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all entries' components in decimal, by part, entry and place."""
    return hashlib.sha256(",".join(str(x) for book in books for entry in book.tolist() for x in entry).encode()).hexdigest()


def encode_vectors(
    vectors: DataFrame,
    *,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    columns: Sequence[str] | None = None,
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
    scale: int = SCALE,
    seen: list[int] | None = None,
) -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256`` of every sound row of ``vectors``, beside ``columns``.

    A component x counts as floor(scale * x). The codebooks start as the parts of the ``entries`` (at most 254) rows of
    the smallest ids (nulls last; among equal ids, the smaller vector), and have as many entries as there are rows
    if these are fewer. ``rounds`` times each entry becomes the floored mean of its parts; unused ones stay. ``code``
    holds two hex digits a part, ``error`` the squared distances summed over parts, ``label_error`` the errors summed
    over rows of the same label, nulls together.

    Rows whose vector is null or holds null, NaN or infinite components are dropped. Vectors that aren't as long as the
    first sound one by id, or not ``parts`` equal parts, or whose components exceed ``largest_component``, can't be
    compared: they stay, without code and error, and don't count. Repeated rows and ids count each. An empty vector's
    parts are empty: code zero. An empty table gives no rows. ``columns`` (all but the vector, if not given) come along
    unless they are named like a column of the result. ``seen`` collects the distances that each round took.
    """
    if not 0 < entries < 255:
        raise ValueError("a codebook has 1 to 254 entries")
    made = ("code", "error", "label_error", "codebooks_sha256")
    named = [c for c in (vectors.columns if columns is None else columns) if c not in (id_col, vector_col) and c.lower() not in {*made, "vec_id"}]
    label = F.col(label_col) if label_col in vectors.columns else F.lit(None).cast("string")
    key = unused("key", named)
    own = F.struct(F.col(id_col).alias("vec_id"), F.struct(label.alias("label")).alias(key), *named)
    sound = F.col("raw").isNotNull() & F.forall("raw", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    raw = vectors.select(own.alias("own"), F.col(vector_col).cast("array<double>").alias("raw")).where(sound)
    bound = F.lit(float(1 << 62))  # beyond what any length takes
    whole = raw.select("own", F.transform("raw", lambda x: F.floor(F.greatest(-bound, F.least(bound, x * scale))).cast("long")).alias("vector"))

    by_id = [F.col("own.vec_id").asc_nulls_last(), "vector"]
    first = whole.orderBy(*by_id).select(F.size("vector")).first()
    size = first[0] if first else 0
    width, most = size // parts, largest_component(size)
    fits = (F.size("vector") == size) & F.lit(size % parts == 0) & F.forall("vector", lambda x: F.abs(x) <= most)
    good, other = whole.where(fits), whole.where(~fits)
    chosen = [r[0] for r in good.orderBy(*by_id).select("vector").limit(entries).collect()]
    start = np.array(chosen, dtype=np.int64).reshape(len(chosen), parts, width)
    books = [Codebook.of(start[:, p], GROUPS) for p in range(parts)]

    kinds = dict(whole.dtypes)["own"]
    state_kind = f"{_STATE} {kinds}"
    state = good.mapInArrow(frugal(_begin(parts, size)), state_kind)
    counts, sums = np.zeros((parts, len(start)), dtype=object), np.zeros((parts, len(start), width), dtype=object)
    for turn in range(rounds + 1 if len(start) else 0):
        state = cut(state.select("vector", "code", "before", "upper", "lower", "taken", "own").mapInArrow(frugal(_step(books, turn == 0)), state_kind))
        if seen is not None:
            seen.append(state.agg(F.sum("taken")).first()[0])
        if turn == rounds:
            break
        changed = state.where("code != before").select("vector", "code", "before")
        moved = changed.mapInArrow(frugal(_moves(parts, width, len(start))), "part long, entry long, place long, value long")
        for part, entry, place, value in moved.groupBy("part", "entry", "place").agg(F.sum(F.col("value").cast("decimal(38,0)"))).collect():
            if place:
                sums[part, entry, place - 1] += int(value)
            else:
                counts[part, entry] += int(value)
        books = [b.replaced(np.array([[s // counts[p, e] for s in sums[p, e]] if counts[p, e] else b.entries[e] for e in range(len(start))], dtype=np.int64).reshape(b.entries.shape)) for p, b in enumerate(books)]

    out = f"code string, error long, own {kinds}"
    coded = state.mapInArrow(frugal(_coded(books)), out) if len(start) else good.select(F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), "own").limit(0)
    coded = cut(coded.unionByName(other.select(F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"), "own")))
    by_label = cut(coded.groupBy(F.col(f"own.{key}").alias("_key")).agg(F.sum("error").alias("label_error"), F.count("*").alias("held")))
    rows = coded.withColumn("_key", F.col(f"own.{key}"))
    few, small = broadcast_within(by_label, BROADCAST_LABELS)
    joined = rows.join(few.drop("held"), "_key") if small else join_uneven(rows, by_label, "_key", "held", by_label.agg(F.sum("held")).first()[0])
    return joined.select("own.vec_id", *(f"own.`{c}`" for c in named), "code", "error", "label_error", F.lit(digest([b.entries for b in books])).alias("codebooks_sha256"))
