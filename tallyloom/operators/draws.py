"""Bootstrap draws equal to numpy's, made by the executors.

``numpy.random.default_rng(seed)`` draws whole numbers below n from one stream of 32-bit words: the halves of a PCG64's
outputs, low half first. A word w becomes ``w n >> 32`` unless ``w n mod 2^32`` is below ``2^32 mod n``; then it is passed
over. The generator can jump ahead, so a task begins anywhere in the stream; where a repetition begins depends only on
how many words were passed over before, which tasks count by blocks first. Results don't depend on partitions, and no
repetition is made on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.operators.shared import cut

#: Outputs of the generator (two words each) in a block at least, the most blocks, and outputs that are made together.
BLOCK_OUTPUTS, MOST_BLOCKS, CHUNK = 1 << 17, 1 << 16, 1 << 17
#: Draws of one repetition that are counted together; a repetition of more groups may name a group several times.
COUNTED = 1 << 24


def _taken(seed: int, n: int, first: int, outputs: int) -> Iterator[np.ndarray]:
    """The numbers below ``n`` from ``outputs`` outputs of the generator after the first ``first``."""
    made = np.random.PCG64(seed).advance(first)
    size, rest = np.uint64(n), np.uint64((1 << 32) % n)
    while outputs > 0:
        words = made.random_raw(min(CHUNK, outputs)).astype("<u8").view("<u4").astype(np.uint64) * size
        yield (words[(words & np.uint64(0xFFFFFFFF)) >= rest] >> np.uint64(32)).astype(np.int64)
        outputs -= CHUNK


@dataclass(frozen=True)
class Draws:
    """``reps`` repetitions of ``n`` draws below ``n``; ``starts`` tells how many draws lie before each block."""

    seed: int
    n: int
    reps: int
    block: int
    starts: np.ndarray

    def between(self, first: int, last: int) -> Iterator[np.ndarray]:
        """Draws ``first`` up to ``last`` of all repetitions' draws one after the other, in pieces."""
        if self.n == 1:  # numpy takes no word for a choice of one
            yield np.zeros(last - first, dtype=np.int64)
            return
        block = int(np.searchsorted(self.starts, first, side="right")) - 1
        at = int(self.starts[block])
        for piece in _taken(self.seed, self.n, block * self.block, (len(self.starts) - block) * self.block):
            if at + len(piece) > first:
                yield piece[max(0, first - at) : last - at]
            at += len(piece)
            if at >= last:
                return

    def repetitions(self, first: int, last: int) -> Iterator[tuple[int, np.ndarray]]:
        """How often each number is drawn in repetitions ``first`` up to ``last``."""
        rep, left, times = first, self.n, np.zeros(self.n, dtype=np.int64)
        for piece in self.between(first * self.n, last * self.n):
            while len(piece):
                own, piece = piece[:left], piece[left:]
                times += np.bincount(own, minlength=self.n)
                left -= len(own)
                if not left:
                    yield rep, times
                    rep, left, times = rep + 1, self.n, np.zeros(self.n, dtype=np.int64)


def _counted(seed: int, n: int, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            held = [sum(map(len, _taken(seed, n, i * block, block))) for i in ids]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(held, pa.int64())], ["id", "held"])

    return run


def plan_draws(spark: SparkSession, n: int, reps: int, seed: int) -> Draws:
    """Find where repetitions begin: tasks count the draws of each block; the driver adds up at most ``MOST_BLOCKS`` numbers."""
    if not 0 < n < 1 << 32:
        raise ValueError(f"draws are of 1 up to 2^32 - 1 groups, not {n}")
    wanted, rest = n * reps, (1 << 32) % n
    if n == 1 or not wanted:
        return Draws(seed, n, reps, BLOCK_OUTPUTS, np.zeros(1, dtype=np.int64))
    outputs = int(wanted / 2 / (1 - rest / (1 << 32)) * 1.01) + BLOCK_OUTPUTS
    while True:
        block = max(BLOCK_OUTPUTS, -(-outputs // MOST_BLOCKS))
        blocks = -(-outputs // block)
        if rest:
            told = spark.range(0, blocks, 1, min(blocks, 4 * spark.sparkContext.defaultParallelism)).mapInArrow(_counted(seed, n, block), "id long, held long")
            held = np.array([r.held for r in sorted(told.collect())], dtype=np.int64)
        else:
            held = np.full(blocks, 2 * block, dtype=np.int64)
        if held.sum() >= wanted:
            return Draws(seed, n, reps, block, np.cumsum(held) - held)
        outputs *= 2


def _repetition_ranges(spark: SparkSession, draws: Draws) -> DataFrame:
    """``first, last``: runs of repetitions, one a task."""
    parts = max(1, min(draws.reps, 2 * spark.sparkContext.defaultParallelism))
    edges = np.linspace(0, draws.reps, parts + 1).astype(int)
    return spark.range(0, parts, 1, parts).select(F.element_at(F.lit(edges[:-1].tolist()), (F.col("id") + 1).cast("int")).alias("first"), F.element_at(F.lit(edges[1:].tolist()), (F.col("id") + 1).cast("int")).alias("last"))


def draw_counts(spark: SparkSession, draws: Draws) -> DataFrame:
    """``rep, rank, times``: how often each of the ``n`` ranks is drawn in each repetition, where it is drawn at all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last in zip(*(c.to_pylist() for c in batch.columns)):
                for rep in range(first, last):
                    for start in range(rep * draws.n, (rep + 1) * draws.n, COUNTED):
                        pieces = list(draws.between(start, min(start + COUNTED, (rep + 1) * draws.n)))
                        ranks, times = np.unique(np.concatenate(pieces), return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ranks), rep, dtype=np.int64)), pa.array(ranks), pa.array(times.astype(np.int64))], ["rep", "rank", "times"])

    return _repetition_ranges(spark, draws).mapInArrow(run, "rep long, rank long, times long")


def weighted_sums(spark: SparkSession, draws: Draws, ranks: np.ndarray, keys: np.ndarray, values: np.ndarray, n_keys: int) -> DataFrame:
    """``rep, key, sums``: every repetition's sums over the groups it draws, by key; no draw leaves its task.

    Row i holds ``values[i]`` (NaN for none) of the group of rank ``ranks[i]`` under ``keys[i]``. A key of which a
    repetition draws no group has no row; a sum of no values is null.
    """
    sent = spark.sparkContext.broadcast((ranks, keys, np.nan_to_num(values), ~np.isnan(values)))
    width = values.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, key, amounts, known = sent.value
        for batch in batches:
            for first, last in zip(*(c.to_pylist() for c in batch.columns)):
                for rep, times in draws.repetitions(first, last):
                    weight = times[place].astype(np.float64)
                    drawn = np.flatnonzero(np.bincount(key, weights=weight, minlength=n_keys))
                    sums = [np.bincount(key, weights=weight * amounts[:, c], minlength=n_keys)[drawn] for c in range(width)]
                    held = [np.bincount(key, weights=weight * known[:, c], minlength=n_keys)[drawn] for c in range(width)]
                    rows = [[float(s[i]) if h[i] else None for s, h in zip(sums, held)] for i in range(len(drawn))]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(drawn), rep, dtype=np.int64)), pa.array(drawn.astype(np.int64)), pa.array(rows, pa.list_(pa.float64()))], ["rep", "key", "sums"])

    return _repetition_ranges(spark, draws).mapInArrow(run, "rep long, key long, sums array<double>")


def sorted_ranks(groups: DataFrame, column: str) -> tuple[DataFrame, int]:
    """``groups`` with ``_rank``, its place from 0 in ascending order of ``column`` (nulls first), and their number.

    Rows are dealt by ranges, sorted within them, and numbered from the sizes of the ranges before, which alone are
    gathered. The sorted rows are written to the checkpoint folder, so that both passes see the same ranges.
    """
    spark = groups.sparkSession
    dealt = groups.repartitionByRange(F.col(column).asc_nulls_first()).sortWithinPartitions(F.col(column).asc_nulls_first())
    placed = cut(dealt.withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    sizes = sorted((r["p"], r["n"]) for r in placed.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())
    offsets, n = [], 0
    for p, size in sizes:
        offsets.append((p, n))
        n += size
    before = F.broadcast(spark.createDataFrame(offsets, "_p long, _before long"))  # one row a partition
    rank = F.col("_at").bitwiseAND((1 << 33) - 1) + F.col("_before")
    return placed.join(before, part == F.col("_p")).withColumn("_rank", rank).drop("_at", "_p", "_before"), n
