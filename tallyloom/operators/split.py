"""Group splits, leakage between them, near-duplicate states, overlap exclusion."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom import schema as S
from tallyloom.functions.text import shingle_hashes
from tallyloom.operators.shared import cut
from tallyloom.operators.skew import join_uneven

NEAR, SHINGLE, LISTED = 0.8, 3, 200
#: Shingles that are counted together, texts (as a power of two) whose shingles are packed together, texts hashed at once,
#: and texts of candidate pairs whose numbers are broadcast to fetch their sets (more are joined).
COUNTED, CHUNK_BITS, HASHED, BROADCAST_TEXTS = 1 << 21, 9, 256, 2_000_000
_ORDER = ("validation", "calibration", "test", "train")


def order_key(seed: int, group: Column) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}:"), group.cast("string")), 256)


def hash_ranks(groups: DataFrame, key: Column) -> tuple[DataFrame, int]:
    """``groups`` with ``_rank``, each row's place from 0 in the order of ``key`` (hex digits of a hash), and their number.

    Rows are ranked within 4096 ranges of equal width, whose sizes alone are gathered.
    """
    keyed = groups.withColumn("_key", key).withColumn("_p", F.substring("_key", 1, 3))
    offsets, n = [], 0
    for row in sorted(keyed.groupBy("_p").count().collect()):
        offsets.append((row["_p"], n))
        n += row["count"]
    before = groups.sparkSession.createDataFrame(offsets, "_p string, _before long")
    place = F.row_number().over(Window.partitionBy("_p").orderBy("_key")) + F.col("_before") - 1
    return keyed.join(F.broadcast(before), "_p").withColumn("_rank", place).drop("_p", "_key", "_before"), n


def assign_groups(df: DataFrame, group: str, seed: int) -> DataFrame:
    """``group, split``: groups in hash order, sliced into validation, calibration, test and the rest for training.

    Each slice has ``max(1, round(ratio n))`` groups, half to even; fewer than four groups fail.
    """
    ranked, n = hash_ranks(df.select(group).distinct(), order_key(seed, F.col(group)))
    if n < len(S.SPLITS):
        raise ValueError(f"at least {len(S.SPLITS)} groups are needed; there are {n}")
    sizes = {s: max(1, round(r * n)) for s, r in S.SPLIT_RATIOS.items()}
    split, end = F.lit("train"), sum(sizes.values())
    for name in reversed(_ORDER[:-1]):
        split = F.when(F.col("_rank") < end, name).otherwise(split)
        end -= sizes[name]
    return ranked.select(group, split.alias("split"))


def split_summary(df: DataFrame, assigned: DataFrame, group: str, label: str) -> DataFrame:
    """``split, groups, examples`` and examples by ``label``."""
    return df.join(assigned, group).groupBy("split", label).agg(F.count_distinct(group).alias("groups"), F.count("*").alias("examples"))


def shared_keys(df: DataFrame, key: str, split: str = "split") -> DataFrame:
    """``split_a, split_b, shared``: keys found in both of each pair of splits (leakage, template overlap).

    Each key's set of splits is an aggregate of at most as many values as there are splits; no self-join.
    """
    sets = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.array_sort(F.collect_set(split)).alias("s")).where(F.size("s") > 1)
    pairs = F.flatten(F.transform("s", lambda a, i: F.transform(F.slice("s", i + 2, F.size("s")), lambda b: F.struct(a.alias("split_a"), b.alias("split_b")))))
    return sets.select(F.explode(pairs).alias("p")).groupBy("p.split_a", "p.split_b").agg(F.count("*").alias("shared"))


def _digested(df: DataFrame, ident: str, text: str, same: str | None) -> DataFrame:
    """``id, same, t, digest``: rows of one ``same`` and text have one digest; a null ``same`` is an empty one."""
    keyed = df.select(F.col(ident).alias("id"), F.col(text).alias("t"), (F.coalesce(F.col(same), F.lit("")) if same else F.lit("")).alias("same"))
    return keyed.withColumn("digest", F.sha2(F.concat_ws("\0", "same", F.coalesce(F.concat(F.lit("t"), F.col("t")), F.lit(""))), 256))


def _hashed(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, HASHED):
                part = batch.slice(start, HASHED)
                seeds = [xxhash.xxh64_intdigest(s, 42) if s else 42 for s in part.column(1).to_pylist()]
                sets = [shingle_hashes(t, size, seed) for t, seed in zip(part.column(2).to_pylist(), seeds)]
                n = np.array([len(s) for s in sets], dtype=np.int32)
                kept = part.column(0).filter(pa.array(n > 0))
                ends = np.concatenate([[0], np.cumsum(n[n > 0])]).astype(np.int32)
                listed = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets).view(np.int64)))
                yield pa.RecordBatch.from_arrays([kept, pa.array(n[n > 0]), listed], ["rep", "n", "sh"])

    return run


def _shingle_sets(rows: DataFrame, size: int) -> DataFrame:
    """``name, rep, n, sh``: each distinct text's number, smallest id and shingles' hashes; written to the shared folder, as all that follows reads it.

    A text's ``same`` seeds its hashes: texts of another one have no hash in common with it.
    """
    texts = rows.groupBy("digest").agg(F.min("id").alias("rep"), F.first("same").alias("same"), F.first("t").alias("t"))
    kind = rows.schema["id"].dataType.simpleString()
    hashed = texts.select("rep", "same", "t").mapInArrow(_hashed(size), f"rep {kind}, n int, sh array<long>")
    return cut(hashed.select(F.monotonically_increasing_id().alias("name"), "rep", "n", "sh"))


def _parted(bits: int):
    """Shingles by their hashes' first ``bits``: a chunk of texts gives each part one row, with the text's place in its
    chunk and 32 further bits of the hash for each shingle. Hashes that agree in all of these count as one shingle,
    which adds candidates and loses none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(0).to_numpy()
            for rows in np.split(np.arange(len(names)), np.flatnonzero(np.diff(names >> CHUNK_BITS)) + 1):
                if not len(rows):
                    continue
                sets = batch.column(1).slice(rows[0], len(rows))
                h = sets.flatten().to_numpy().view(np.uint64)
                at = np.repeat(names[rows] & (1 << CHUNK_BITS) - 1, np.diff(sets.offsets.to_numpy())).astype("<u2")
                part = (h >> np.uint64(64 - bits)).astype(np.int32)
                by = np.argsort(part, kind="stable")
                at, low = at[by], (h[by] << np.uint64(bits) >> np.uint64(32)).astype("<u4")
                parts, starts = np.unique(part[by], return_index=True)
                bounds = [*starts.tolist(), len(by)]
                packed = [pa.array([c[i:j].tobytes() for i, j in zip(bounds, bounds[1:])], pa.binary()) for c in (at, low)]
                yield pa.RecordBatch.from_arrays([pa.array(parts), pa.array(np.full(len(parts), names[rows[0]] >> CHUNK_BITS)), *packed], ["part", "chunk", "at", "h"])

    return run


def _unpacked(column: pa.ChunkedArray, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """All values of packed rows, and how many each row has."""
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), dtype=kind), np.array([len(r) for r in rows], dtype=np.int64) // np.dtype(kind).itemsize


def _counted(table: pa.Table) -> pa.Table:
    """The rows of a part without shingles of one text alone, and with each shingle's number of texts."""
    (at, sizes), (h, _) = _unpacked(table.column("at"), "<u2"), _unpacked(table.column("h"), "<u4")
    _, which, counts = np.unique(h, return_inverse=True, return_counts=True)
    f = counts[which].astype("<u4")
    shared = f > 1
    ends = np.concatenate([[0], np.cumsum(shared)])[np.cumsum(sizes)].tolist()
    packed = [pa.array([c[i:j].tobytes() for i, j in zip([0, *ends], ends)], pa.binary()) for c in (at[shared], h[shared], f[shared])]
    return pa.Table.from_arrays([table.column("chunk"), table.column("part"), *packed], ["chunk", "part", "at", "h", "f"])


def _prefixes(threshold: float):
    def run(rows: pa.Table, texts: pa.Table) -> pa.Table:
        """A chunk's texts under the shared shingles of their prefixes, with the shingle's place among all of the text's."""
        (at, sizes), (h, _), (f, _) = _unpacked(rows.column("at"), "<u2"), _unpacked(rows.column("h"), "<u4"), _unpacked(rows.column("f"), "<u4")
        key = np.repeat(rows.column("part").to_numpy().astype(np.int64), sizes) << 32 | h
        names, n = texts.column("name").to_numpy(), np.zeros(1 << CHUNK_BITS, dtype=np.int64)
        n[names & (1 << CHUNK_BITS) - 1] = texts.column("n").to_numpy()
        by = np.lexsort((key, f, at))
        at, key = at[by], key[by]
        _, starts, shared = np.unique(at, return_index=True, return_counts=True)
        n = n[at]
        place = np.arange(len(at)) - np.repeat(starts + shared, shared) + n  # the text's own shingles come before
        kept = place < n - np.ceil(n * threshold - 1e-9) + 1
        name = names[0] >> CHUNK_BITS << CHUNK_BITS | at[kept].astype(np.int64)
        return pa.Table.from_arrays([pa.array(key[kept]), pa.array(name), pa.array(place[kept].astype(np.int32)), pa.array(n[kept].astype(np.int32))], ["key", "name", "place", "n"])

    return run


def near_duplicate_pairs(df: DataFrame, ident: str, text: str, *, threshold: float = NEAR, size: int = SHINGLE, same: str | None = None) -> DataFrame:
    """``a, b, jaccard`` of all pairs of different rows whose word-shingle sets have at least ``threshold`` similarity.

    Equal texts are compared once and their rows paired by the caller's ids. Exact by prefix filtering: with shingles
    ordered from the rarest, two similar sets share one among their first ``n - ceil(threshold n) + 1``; pairs that meet
    there are filtered by length and place and verified by intersection. Shingles of one text alone come first in that
    order and join nothing, so only shared ones are sorted. A shingle is shuffled once, packed in six bytes, to be
    counted, and a shared one once more, in ten. ``same`` names a column that must agree.
    """
    return _similar_pairs(_shingle_sets(_digested(df, ident, text, same), size), threshold)


def _similar_pairs(sets: DataFrame, threshold: float) -> DataFrame:
    total = sets.agg(F.sum("n")).first()[0] or 0
    bits = min(16, max(4, (total // COUNTED).bit_length()))
    parted = sets.select("name", "sh").mapInArrow(_parted(bits), "part int, chunk long, at binary, h binary")
    counted = parted.groupBy("part").applyInArrow(_counted, "chunk long, part int, at binary, h binary, f binary")
    sizes = sets.select(F.shiftright("name", CHUNK_BITS).alias("chunk"), "name", "n")
    prefix = cut(counted.groupBy("chunk").cogroup(sizes.groupBy("chunk")).applyInArrow(_prefixes(threshold), "key long, name long, place int, n int"))
    a, b = prefix.alias("a"), prefix.alias("b")
    near = (F.col("a.key") == F.col("b.key")) & (F.col("a.name") < F.col("b.name"))
    sized = (F.col("a.n") * threshold <= F.col("b.n") + 1e-9) & (F.col("b.n") * threshold <= F.col("a.n") + 1e-9)
    rest = F.least(F.col("a.n") - F.col("a.place"), F.col("b.n") - F.col("b.place"))
    enough = rest * (1 + threshold) >= threshold * (F.col("a.n") + F.col("b.n")) - 1e-9  # what both may still share
    met = cut(a.join(b, near & sized & enough).select(F.col("a.name").alias("u"), F.col("b.name").alias("v")).distinct())
    wanted = met.select(F.explode(F.array("u", "v")).alias("name")).distinct()
    if wanted.limit(BROADCAST_TEXTS + 1).count() <= BROADCAST_TEXTS:
        sets = sets.join(F.broadcast(wanted), "name", "left_semi")
    one, other = (sets.select(F.col("name").alias(k), F.col("rep").alias(f"r{k}"), F.col("sh").alias(f"s{k}")) for k in ("u", "v"))
    inter = F.size(F.array_intersect("su", "sv"))
    verified = met.join(one, "u").join(other, "v").withColumn("jaccard", inter / (F.size("su") + F.size("sv") - inter)).where(F.col("jaccard") >= threshold - 1e-12)
    return verified.select(F.least("ru", "rv").alias("a"), F.greatest("ru", "rv").alias("b"), "jaccard")


def near_duplicate_rows(df: DataFrame, ident: str, text: str, *, threshold: float = NEAR, size: int = SHINGLE, same: str | None = None) -> DataFrame:
    """One row per row of ``df``: ``id, rep`` (the smallest id of its text) and ``links``, the other texts near to it.

    A text may have any share of the rows: they are joined to it by ``join_uneven``.
    """
    rows = _digested(df, ident, text, same)
    pairs = cut(_similar_pairs(_shingle_sets(rows, size), threshold))
    links = pairs.select(F.col("a").alias("rep")).unionByName(pairs.select(F.col("b").alias("rep"))).groupBy("rep").agg(F.count("*").alias("links"))
    named = cut(rows.select("id", "digest"))
    reps = named.groupBy("digest").agg(F.min("id").alias("rep"), F.count("*").alias("held"))
    told = cut(reps.join(links, "rep", "left").select("digest", "rep", F.coalesce("links", F.lit(0)).alias("links"), "held"))
    return join_uneven(named, told, "digest", "held", named.count()).select("id", "rep", "links")


def near_duplicate_states(df: DataFrame, split: str, group: str, text: str, *, same: str | None = None, limit: int = LISTED) -> tuple[DataFrame, int]:
    """Near-duplicate states between splits: the first ``limit`` pairs (``split_a, split_b, group_a, group_b, jaccard``)
    and how many there are.

    A group's distinct states are compared; equal texts of different splits count as pairs too.
    """
    states = df.select(F.col(split).alias("split"), F.col(group).alias("grp"), F.col(text).alias("t"), (F.coalesce(F.col(same), F.lit("")) if same else F.lit("")).alias("same")).distinct()
    states = states.withColumn("id", F.sha2(F.concat_ws("\0", "same", "t"), 256))
    pairs = near_duplicate_pairs(states, "id", "t", same="same")
    equal = states.select(F.col("id").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("jaccard")).distinct()
    left, right = states.select(F.col("id").alias("a"), F.col("split").alias("sa"), F.col("grp").alias("ga")), states.select(F.col("id").alias("b"), F.col("split").alias("sb"), F.col("grp").alias("gb"))
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "jaccard")).unionByName(equal)
    found = both.join(left, "a").join(right, "b").where("sa < sb")
    rows = found.select(F.col("sa").alias("split_a"), F.col("sb").alias("split_b"), F.col("ga").alias("group_a"), F.col("gb").alias("group_b"), F.round("jaccard", 3).alias("jaccard"))
    return rows.orderBy("split_a", "split_b", "group_a", "group_b", "jaccard").limit(limit), rows.count()


def exclude_overlap(df: DataFrame, reference: DataFrame, group: str, key: str) -> DataFrame:
    """``df`` without any group that has a ``key`` found in ``reference``."""
    hit = df.join(reference.select(key).distinct(), key, "left_semi").select(group).distinct()
    return df.join(hit, group, "left_anti")


def check_split(examples: DataFrame, manifest: DataFrame, *, ident: str = "id", group: str = "group_id", digest: str = "input_sha256") -> None:
    """The manifest (id, group, split, digest) must name every example once, with its group and digest, and no group twice."""
    joined = examples.alias("e").join(manifest.alias("m"), F.col(f"e.{ident}") == F.col(f"m.{ident}"), "full_outer")
    one = F.col(f"e.{ident}").isNull() | F.col(f"m.{ident}").isNull()
    wrong = joined.agg(
        F.count_if(one).alias("ids that only one has"),
        F.count_if(~one & ~F.col(f"e.{group}").eqNullSafe(F.col(f"m.{group}"))).alias("other groups"),
        F.count_if(~one & ~F.col(f"e.{digest}").eqNullSafe(F.col(f"m.{digest}"))).alias("other inputs"),
    ).first().asDict()
    wrong["repeated ids"] = manifest.groupBy(ident).count().where("count > 1").count()
    wrong["groups in several splits"] = manifest.groupBy(group).agg(F.count_distinct("split").alias("n")).where("n > 1").count()
    if found := {k: v for k, v in wrong.items() if v}:
        raise ValueError(f"the split does not fit the dataset: {found}")


def read_split(manifest: DataFrame, splits: list[str], *, allow_test: bool = False) -> DataFrame:
    """The manifest's rows of ``splits``; the test split is only given if it is asked for by ``allow_test``."""
    if "test" in splits and not allow_test:
        raise ValueError("the test split needs allow_test")
    return manifest.where(F.col("split").isin(*splits))
