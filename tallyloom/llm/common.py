"""Helpers that the corpus operators share: shared folders, size-checked broadcasts, word boundaries."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that separate words: space, tab, newline, vertical tab, form feed, carriage return.
SPACE_BYTES = b" \t\n\x0b\x0c\r"
#: The same as a Java and Python character class.
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

#: Rows that go to Python together.
ROWS_PER_BATCH = 512

_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[list(SPACE_BYTES)] = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares, from ``spark.checkpoint.dir``; a local one only where that is unset."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    current = context._jsc.sc().getCheckpointDir()
    if named is None:
        if current.isDefined():
            return current.get()
        named = tempfile.mkdtemp(prefix="tallyloom-")
    if not current.isDefined():
        context.setCheckpointDir(named)
    return named


def unused(name: str, columns: Iterable[str]) -> str:
    """``name``, with as many underscores before it as tell it from all ``columns``."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from there, so that a lost executor costs no more than its tasks."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def broadcast_within(df: DataFrame, max_rows: int) -> tuple[DataFrame, bool]:
    """``df`` marked for broadcast if it holds at most ``max_rows`` rows, else as it is; and which of the two."""
    small = df.limit(max_rows + 1).count() <= max_rows
    return (F.broadcast(df) if small else df), small


def release_memory() -> None:
    """Give freed memory back to the machine: a worker that waits for its next task holds little beside other tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # only where the C library has it
        ctypes.CDLL(None).malloc_trim(0)


def frugal(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, releasing memory when a partition is over."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release_memory()

    return wrapped


def small_batches(spark: SparkSession) -> None:
    """Send documents to Python a few hundred at a time (a setting of the session): Spark's default of 10,000 rows would
    hold tens of megabytes of text for each task on both sides, and far more where texts are long."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > ROWS_PER_BATCH:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_PER_BATCH))


def text_runs(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """The rows of all batches in order, in runs of about ``most_bytes`` of text; a longer text stands alone."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        for part in text_slices(batch, column, most_bytes):
            own = pc.sum(pc.binary_length(part.column(column))).as_py() or 0
            if held and size + own > most_bytes:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, size = [], 0
            held.append(part)
            size += own
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def text_slices(batch: pa.RecordBatch, column: str, most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose texts take about ``most_bytes`` together; a longer text stands alone."""
    if not batch.num_rows:
        return
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        base = sizes[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(sizes, base + most_bytes, side="right")))
        yield batch.slice(start, end - start)
        start = end


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, end to end, and where each begins and ends; a null text is empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, dtype=np.uint8)
    return data, offsets - offsets[0]


def count_words(column: pa.Array) -> np.ndarray:
    """Words of each text; a null text has none."""
    data, offsets = text_bytes(column)
    space = _IS_SPACE[data]
    starts = ~space
    starts[1:] &= space[:-1]
    first = offsets[:-1][offsets[:-1] < offsets[1:]]
    starts[first] = ~space[first]
    return np.diff(np.searchsorted(np.flatnonzero(starts), offsets))


def split_words(text: str | None) -> list[bytes]:
    """The text's words as UTF-8; ``bytes.split`` knows exactly SPACE_BYTES."""
    return text.encode("utf-8").split() if text else []
