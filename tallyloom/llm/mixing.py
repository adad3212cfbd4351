"""Mixing sources to target weights by subset-sum budget fitting.

Documents are counted by exact length within each source. Whole copies of a source are taken while the target
allows; for the rest, lengths are allotted in proportion and a bounded-knapsack programme over the counted
lengths fits the remaining budget. Which documents of a length are taken follows a seeded hash.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.llm.common import count_words, cut, frugal, small_batches, text_slices

#: Words of a source's budget that the knapsack programme fits; what lies above is allotted in proportion.
KNAPSACK_WORDS = 1 << 15
#: Parts into which the documents of one source and length are dealt by hash before they are ranked.
RANK_PARTS = 1024


def fit_lengths(sizes: np.ndarray, counts: np.ndarray, budget: int, window: int = KNAPSACK_WORDS) -> np.ndarray:
    """How many documents of each length to take so that their words come as near below ``budget`` as can be found.

    All but ``window`` words are allotted in proportion to the counts (longest first, each step mending the rounding
    of those before it, and none beyond the budget); a bounded knapsack over what is left of each length then fits the
    rest. A budget within the window is fitted by the knapsack alone, which reaches the best sum. Beyond it the words
    that are missed are fewer than the shortest length of which a document is left.
    """
    sizes, counts = np.asarray(sizes, dtype=np.int64), np.asarray(counts, dtype=np.int64)
    taken = np.zeros(len(sizes), dtype=np.int64)
    total = int((sizes * counts).sum())
    if budget >= total:
        return np.where(sizes > 0, counts, 0)
    if budget <= 0:
        return taken
    order = np.argsort(-sizes, kind="stable")
    share, ideal, got = max(0, budget - window) / total, 0.0, 0
    for i in order:
        size, count = int(sizes[i]), int(counts[i])
        if size == 0:
            continue
        ideal += size * count * share
        taken[i] = min(count, max(0, round((ideal - got) / size)), (budget - got) // size)
        got += size * int(taken[i])
    return taken + knapsack(sizes, counts - taken, budget - got)


def knapsack(sizes: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """Bounded knapsack: counts of each length whose words are the largest reachable sum within ``budget``."""
    taken = np.zeros(len(sizes), dtype=np.int64)
    if budget <= 0:
        return taken
    items: list[tuple[int, int, int]] = []  # length's place, copies, words
    reachable = np.zeros(budget + 1, dtype=bool)
    reachable[0] = True
    made_by = np.full(budget + 1, -1, dtype=np.int32)
    for i in np.argsort(-sizes, kind="stable"):
        size = int(sizes[i])
        left = min(int(counts[i]), budget // size) if size else 0
        copies = 1
        while left > 0 and not reachable[budget]:
            copies = min(copies, left)
            words = copies * size
            fresh = np.flatnonzero(reachable[: budget + 1 - words] & ~reachable[words:]) + words
            reachable[fresh] = True
            made_by[fresh] = len(items)
            items.append((int(i), copies, words))
            left -= copies
            copies *= 2
        if reachable[budget]:
            break
    at = int(np.flatnonzero(reachable)[-1])
    while at:
        i, copies, words = items[made_by[at]]
        taken[i] += copies
        at -= words
    return taken


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in text_slices(batch, "text"):
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(3), pa.array(count_words(part.column(2)), pa.int64())], ["doc_id", "source", "print", "size"])


def source_targets(sources: DataFrame, weights: Sequence[float], share: float, max_repeat: float) -> DataFrame:
    """Add ``target`` to one row per source (``source_key``, ``source_size``).

    Sources in key order weigh ``weights``, repeating, and share ``share`` times all words. No target is above
    ``max_repeat`` times its source; the excess goes to the others by weight. With the sources ordered by the level
    at which each reaches its bound, the ones at their bound are a prefix, so two running sums give the level.
    The windows have no partition key: their one task reads one short row per source.
    """
    by_key, by_level = Window.orderBy("source_key"), Window.orderBy("bound_level", "source_key")
    before, after = by_level.rowsBetween(Window.unboundedPreceding, -1), by_level.rowsBetween(0, Window.unboundedFollowing)
    everything = by_level.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    rows = (
        sources.withColumn("weight", F.element_at(cycle, (F.row_number().over(by_key) - 1) % len(weights) + 1))
        .withColumn("bound", max_repeat * F.col("source_size"))
        .withColumn("bound_level", F.col("bound") / F.col("weight"))
        .withColumn("left", share * F.sum("source_size").over(everything) - F.coalesce(F.sum("bound").over(before), F.lit(0.0)))
        .withColumn("level", F.col("left") / F.sum("weight").over(after))
        .withColumn("final", F.first(F.when(F.col("bound_level") > F.col("level"), F.col("level")), ignorenulls=True).over(everything))
    )
    target = F.when(F.col("final").isNull(), F.col("bound")).otherwise(F.least(F.col("bound"), F.col("weight") * F.col("final")))
    return rows.select("source_key", "source_size", target.alias("target"))


_PLAN = T.StructType(
    [T.StructField("source_key", T.StringType()), T.StructField("size", T.LongType()), T.StructField("source_size", T.LongType()), T.StructField("target", T.DoubleType()), T.StructField("copies", T.LongType()), T.StructField("extra", T.LongType())]
)


def _plan(window: int):
    def plan(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("size")
        total, goal = rows["source_size"][0].as_py(), int(np.floor(rows["target"][0].as_py() + 0.5))
        copies = goal // total if total else 0
        extra = fit_lengths(rows["size"].to_numpy(), rows["n"].to_numpy(), goal - copies * total, window)
        kept = rows.select(["source_key", "size", "source_size", "target"])
        return kept.append_column("copies", pa.array(np.full(len(extra), copies, dtype=np.int64))).append_column("extra", pa.array(extra))

    return plan


def mix_sources(
    docs: DataFrame,
    *,
    weights: Sequence[float] = (5, 2, 1),
    share: float = 1.5,
    max_repeat: float = 2.0,
    seed: int = 20240,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    window: int = KNAPSACK_WORDS,
) -> DataFrame:
    """One row per document: ``doc_id, print, source_key, size, source_size, target, copies`` and ``taken``.

    ``print`` is a hash of the text, ``copies`` how often the mix takes the document and ``taken`` the words that makes. A null or empty text has
    size 0 and is taken zero times more than its source's whole copies. A null source is a source of its own, after
    all others; a null id ranks like any other value. Rows of the same id are documents of their own. Documents of one
    length are taken in the order of a seeded hash of their ids, ties by id and text. A text of any length is one of
    its length; one longer than what is left of its source's target is taken only with whole copies. An empty table
    gives no rows; other columns are not read, whatever their names.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.col(text_col).alias("text"), F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("print"))
    id_type = rows.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("doc_id", id_type), T.StructField("source", T.StringType()), T.StructField("print", T.LongType()), T.StructField("size", T.LongType())])
    key: Column = F.when(F.col("source").isNull(), F.lit("t")).otherwise(F.concat(F.lit("s"), F.col("source")))
    rank = F.xxhash64(F.lit(seed), F.col("doc_id").cast("string"))
    small_batches(rows.sparkSession)
    sized = cut(rows.mapInArrow(frugal(_sizes), schema).select("doc_id", "print", "size", key.alias("source_key"), rank.alias("rank")))
    sized = sized.withColumn("part", F.pmod("rank", F.lit(RANK_PARTS)).cast("int"))

    cells = sized.groupBy("source_key", "size", "part").agg(F.count("*").alias("n"))
    lengths = cells.groupBy("source_key", "size").agg(F.sum("n").alias("n"))
    sources = lengths.groupBy("source_key").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    targets = source_targets(sources, weights, share, max_repeat)
    plan = cut(lengths.join(targets, "source_key").groupBy("source_key").applyInArrow(_plan(window), _PLAN))

    earlier = Window.partitionBy("source_key", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    decided = (
        cells.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
        .join(plan, ["source_key", "size"])
        .withColumn("quota", F.greatest(F.lit(0), F.least(F.col("n"), F.col("extra") - F.col("before"))))
        .select("source_key", "size", "part", "source_size", "target", "copies", "quota")
    )
    place = Window.partitionBy("source_key", "size", "part").orderBy("rank", "doc_id", "print")
    times = F.col("copies") + F.when(F.col("place") <= F.col("quota"), 1).otherwise(0)
    return (
        sized.withColumn("place", F.row_number().over(place))
        .join(decided, ["source_key", "size", "part"])
        .select("doc_id", "print", "source_key", "size", "source_size", "target", times.alias("copies"), (F.col("size") * times).alias("taken"))
    )
