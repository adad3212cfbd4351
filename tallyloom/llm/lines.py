"""Line deduplication over levelled sorted runs of line hashes.

A run is a table of line keys (128-bit hashes), bucketed and sorted by key, with how many documents hold each and the
largest of their ids. Every batch adds a run to the lowest level; ``fanout`` runs of a level are merged into one of the
next. Runs share their bucketing, so that anti-joining a batch with them is a sort-merge join that moves only the batch.
A merge deals the runs out by key again. Spark 4.1 takes a union of bucketed tables for partitioned by key, which it
isn't, and would leave keys of different runs apart; ``LineRuns`` turns that off for the session.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.common import SPACE_BYTES, cut, frugal, small_batches, text_slices

_SPACE = SPACE_BYTES.decode()
#: Keys to drop up to which they are sent to every task (24 bytes each); more of them are joined by key.
BROADCAST_KEYS = 400_000
KEY = ["hi", "lo"]


def line_key(line: str, min_chars: int) -> bytes | None:
    """The hash of a line stripped and in lower case (A-Z), or None for a key of fewer code points."""
    key = line.strip(_SPACE)
    return xxhash.xxh3_128_digest(key.encode().lower()) if len(key) >= min_chars else None


def _halves(digests: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    pairs = np.frombuffer(b"".join(digests), dtype=">i8").astype(np.int64).reshape(-1, 2)
    return pairs[:, 0], pairs[:, 1]


def _keys(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text"):
                digests, rows = [], []
                for row, text in enumerate(part.column(1).to_pylist()):
                    own = {line_key(line, min_chars) for line in (text or "").split("\n")} - {None}
                    digests += own
                    rows += [row] * len(own)
                hi, lo = _halves(digests)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows, pa.int64())), pa.array(hi), pa.array(lo)], ["doc_id", *KEY])

    return run


def line_keys(docs: DataFrame, min_chars: int) -> DataFrame:
    """``(doc_id, hi, lo)``: each document's distinct line keys; ``docs`` has ``doc_id`` and ``text``."""
    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(frugal(_keys(min_chars)), "doc_id long, hi long, lo long")


class LineRuns:
    """The levels of runs, as bucketed tables of the session's catalog; ``drop()`` removes them."""

    def __init__(self, spark: SparkSession, fanout: int = 4, buckets: int | None = None) -> None:
        self.spark, self.fanout = spark, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.name = f"line_runs_{uuid.uuid4().hex}"
        spark.conf.set("spark.sql.unionOutputPartitioning", "false")
        self.levels: list[list[str]] = []
        self.made = 0

    def _write(self, rows: DataFrame, level: int) -> None:
        """``rows`` are dealt into ``buckets`` partitions by key."""
        while len(self.levels) <= level:
            self.levels.append([])
        table = f"{self.name}_{self.made}"
        self.made += 1
        rows.write.bucketBy(self.buckets, *KEY).sortBy(*KEY).saveAsTable(table)
        self.levels[level].append(table)
        if len(self.levels[level]) >= self.fanout:
            self._compact(level)

    def _compact(self, level: int) -> None:
        tables, self.levels[level] = self.levels[level], []
        self._write(self._merge(tables), level + 1)
        for table in tables:
            self.spark.sql(f"DROP TABLE {table}")

    def _merge(self, tables: list[str]) -> DataFrame:
        rows = self.spark.table(tables[0])
        for table in tables[1:]:
            rows = rows.unionByName(self.spark.table(table))
        return rows.repartition(self.buckets, *KEY).groupBy(*KEY).agg(F.sum("n").alias("n"), F.max("last").alias("last"))

    def tables(self) -> list[str]:
        return [table for level in self.levels for table in level]

    def add(self, keys: DataFrame) -> None:
        """Add a batch's ``(doc_id, hi, lo)`` as a run, and compact the levels that are full."""
        counted = keys.groupBy(*KEY).agg(F.count("*").alias("n"), F.max("doc_id").alias("last"))
        self._write(counted.repartition(self.buckets, *KEY), 0)

    def fresh(self, keys: DataFrame) -> DataFrame:
        """The rows of ``keys`` whose key no run holds."""
        for table in self.tables():
            keys = keys.join(self.spark.table(table).hint("merge"), KEY, "left_anti")
        return keys

    def merged(self) -> DataFrame:
        """``(hi, lo, n, last)`` over all runs."""
        return self._merge(self.tables())

    def drop(self) -> None:
        for table in self.tables():
            self.spark.sql(f"DROP TABLE {table}")
        self.levels = []


def _drop_known(min_chars: int, known) -> object:
    """Drops lines by the sorted keys that ``known`` has been sent, unless their last document is this one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        all_hi, all_lo, all_last, most = known.value

        def dropped(doc_id: int | None, digests: list[bytes]) -> np.ndarray:
            hi, lo = _halves(digests)
            out = np.zeros(len(hi), dtype=bool)
            if len(all_hi):
                at = np.searchsorted(all_hi, hi)
                for _ in range(most):  # keys whose upper halves agree follow each other
                    i = np.minimum(at, len(all_hi) - 1)
                    out |= (all_hi[i] == hi) & (all_lo[i] == lo) & (True if doc_id is None else all_last[i] > doc_id)
                    at = at + 1
            return out

        for batch in batches:
            yield from _without(batch, min_chars, lambda row, doc_id, digests: dropped(doc_id, digests))

    return run


def _drop_listed(min_chars: int):
    """Drops the lines whose keys stand in the row's own list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            listed = batch.column(batch.schema.get_field_index("gone"))

            def dropped(row: int, doc_id: int | None, digests: list[bytes], listed=listed) -> np.ndarray:
                gone = {(k["hi"], k["lo"]) for k in listed[row].as_py() or ()}
                return np.array([k in gone for k in zip(*(h.tolist() for h in _halves(digests)))], dtype=bool)

            yield from _without(batch, min_chars, dropped)

    return run


def _without(batch: pa.RecordBatch, min_chars: int, dropped) -> Iterator[pa.RecordBatch]:
    row = 0
    for part in text_slices(batch, "text"):
        kept_texts, n_lines, n_dropped = [], [], []
        for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
            lines = (text or "").split("\n")
            keys = [line_key(line, min_chars) for line in lines]
            long = [i for i, k in enumerate(keys) if k is not None]
            gone = {i for i, out in zip(long, dropped(row, doc_id, [keys[i] for i in long])) if out} if long else set()
            kept_texts.append("\n".join(line for i, line in enumerate(lines) if i not in gone) if gone else text or "")
            n_lines.append(len(lines))
            n_dropped.append(len(gone))
            row += 1
        yield pa.RecordBatch.from_arrays([part.column(0), pa.array(kept_texts, pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], ["doc_id", "text", "n_lines", "n_dropped"])


_OUT = "doc_id long, text string, n_lines long, n_dropped long"


def dedup_lines(
    docs: DataFrame,
    *,
    min_docs: int = 5,
    min_chars: int = 40,
    batches: int = 4,
    fanout: int = 4,
    id_col: str = "doc_id",
    text_col: str = "text",
    broadcast_keys: int = BROADCAST_KEYS,
) -> DataFrame:
    """One row per document: ``doc_id, text`` (what is kept), ``n_lines`` and ``n_dropped``.

    A line whose key has ``min_chars`` code points and is found in ``min_docs`` documents stays only in the largest
    ``doc_id`` that holds it. A null or empty text is one empty line. Every row counts as a document, also where ids
    repeat; rows that share the largest id all keep the line. A null id is below all others: its rows lose the line to
    any other id, and keep it where only null ids hold it. An empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    keys = cut(line_keys(rows, min_chars))
    runs = LineRuns(spark, fanout)
    for number in range(batches):
        runs.add(keys.where(F.pmod(F.xxhash64("doc_id"), F.lit(batches)) == number))
    gone = cut(runs.merged().where((F.col("n") >= min_docs) & F.col("last").isNotNull()).select(*KEY, "last"))
    runs.drop()

    if gone.limit(broadcast_keys + 1).count() <= broadcast_keys:
        local = gone.orderBy(*KEY).toPandas()
        hi = local["hi"].to_numpy(np.int64)
        most = int(np.unique(hi, return_counts=True)[1].max(initial=0))
        known = spark.sparkContext.broadcast((hi, local["lo"].to_numpy(np.int64), local["last"].to_numpy(np.int64), most))
        small_batches(rows.sparkSession)
        return rows.mapInArrow(frugal(_drop_known(min_chars, known)), _OUT)
    lost = keys.join(gone, KEY).where(F.col("doc_id").isNull() | (F.col("doc_id") < F.col("last")))
    listed = lost.groupBy("doc_id").agg(F.collect_set(F.struct(*KEY)).alias("gone")).withColumnRenamed("doc_id", "holder")
    joined = rows.join(listed, F.col("doc_id").eqNullSafe(F.col("holder")), "left")
    small_batches(joined.sparkSession)
    return joined.select("doc_id", "text", "gone").mapInArrow(frugal(_drop_listed(min_chars)), _OUT)


def dedup_batch(runs: LineRuns, docs: DataFrame, *, min_chars: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Incremental use: the batch without the lines that ``runs`` hold from earlier batches; then adds the batch's own.

    Lines that repeat within the batch stay. Columns as ``dedup_lines``; nulls likewise. The result is written to the
    shared checkpoint folder before the batch's lines join the runs.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    keys = cut(line_keys(rows, min_chars))
    known = keys.join(runs.fresh(keys.select(*KEY).distinct()), KEY, "left_anti")
    listed = known.groupBy("doc_id").agg(F.collect_set(F.struct(*KEY)).alias("gone")).withColumnRenamed("doc_id", "holder")
    joined = rows.join(listed, F.col("doc_id").eqNullSafe(F.col("holder")), "left")
    small_batches(joined.sparkSession)
    out = cut(joined.select("doc_id", "text", "gone").mapInArrow(frugal(_drop_listed(min_chars)), _OUT))
    runs.add(keys)
    return out
