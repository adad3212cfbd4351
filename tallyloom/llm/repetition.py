"""Quality rules by repetition, from suffix arrays over words.

The documents of a slice share one suffix array: words carry their document's number, so no common prefix crosses
documents. The longest-common-prefix values of neighbouring suffixes delimit the intervals of maximal repeated
substrings; the longest one that begins at a position is the larger of its two neighbours' values. The union of their
spans gives the covered fraction of the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import SPACE_BYTES, frugal, small_batches, text_bytes, text_slices

#: Characters that count as symbols.
SYMBOLS = b"#*$%&|<>"
_SPACE = SPACE_BYTES.decode()
_IS_SYMBOL = np.zeros(256, dtype=bool)
_IS_SYMBOL[list(SYMBOLS)] = True

#: Words from which a repeated substring counts towards the covered fraction.
MIN_REPEAT = 10
#: Kept documents have at most this fraction of their words in such substrings.
MAX_COVERED = 0.3
#: Kept documents have no repeated substring of more words.
MAX_LONGEST = 60
#: Bytes of text that share a suffix array.
SLICE_BYTES = 2 << 20


def suffix_array(codes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The suffixes of all documents in order, and the ranks by the first 1, 2, 4, ... words.

    ``codes`` are the words' numbers, different for different documents; ``ends`` is where each word's document ends.
    Prefix doubling that sorts again only the suffixes that still share a rank. A rank is the first place of those
    that share it, so two suffixes share that many words exactly if their ranks agree.
    """
    n = len(codes)
    order = np.argsort(codes)
    fresh = np.ones(n, dtype=bool)
    fresh[1:] = codes[order[1:]] != codes[order[:-1]]
    slots = np.arange(n)
    first = np.maximum.accumulate(np.where(fresh, slots, 0))
    rank = np.empty(n, dtype=np.int32)
    rank[order] = first
    ranks, length = [rank.copy()], 1
    alone = fresh & np.append(fresh[1:], True)
    slots = slots[~alone]
    while len(slots):
        at = order[slots]
        then = at + length
        inside = then < ends[at]
        second = np.zeros(len(at), dtype=np.int64)
        second[inside] = rank[then[inside]] + 1
        keys = rank[at].astype(np.int64) * (n + 1) + second
        by = np.argsort(keys)
        at, keys = at[by], keys[by]
        order[slots] = at
        fresh = np.ones(len(at), dtype=bool)
        fresh[1:] = keys[1:] != keys[:-1]
        rank[at] = slots[np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))]
        ranks.append(rank.copy())
        length *= 2
        slots = slots[~(fresh & np.append(fresh[1:], True))]
    return order, ranks


def longest_repeats(codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For every position the words of the longest substring that begins there and is found again in its document."""
    longest = np.zeros(len(codes), dtype=np.int64)
    if len(codes) < 2:
        return longest
    order, ranks = suffix_array(codes, ends)
    ranks = [np.append(r, -1) for r in ranks]
    a, b = order[:-1], order[1:]
    alike = ranks[0][a] == ranks[0][b]
    a, b = a[alike], b[alike]
    shared = np.zeros(len(a), dtype=np.int64)
    for power in reversed(range(len(ranks))):
        ia, ib = np.minimum(a + shared, len(codes)), np.minimum(b + shared, len(codes))
        same = (ranks[power][ia] == ranks[power][ib]) & (ia != ib)
        shared[same] += 1 << power
    np.maximum.at(longest, a, shared)
    np.maximum.at(longest, b, shared)
    return longest


def _covered(longest: np.ndarray, least: int, most: int | None = None) -> np.ndarray:
    """Which words lie in a repeat of at least ``least`` words; ``most`` cuts each repeat's span."""
    at = np.flatnonzero(longest >= least)
    spans = longest[at] if most is None else np.full(len(at), most)
    steps = np.bincount(at, minlength=len(longest) + 1) - np.bincount(at + spans, minlength=len(longest) + 1)
    return np.cumsum(steps[:-1]) > 0


def _sum_by(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(values)])[bounds])


def measure(texts: pa.Array, min_repeat: int = MIN_REPEAT) -> dict[str, np.ndarray]:
    """The measures of each text, as ``repetition`` names them."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    lists = pc.ascii_split_whitespace(texts)
    words = lists.flatten()
    real = pc.not_equal(words, "")
    kept = np.concatenate([[0], np.cumsum(real.to_numpy(zero_copy_only=False))])
    bounds = lists.offsets.to_numpy().astype(np.int64)
    bounds = kept[bounds - bounds[0]]
    coded = words.filter(real).dictionary_encode()
    codes = coded.indices.to_numpy().astype(np.int64)
    chars = pc.utf8_length(coded.dictionary).to_numpy().astype(np.int64)
    counts = np.diff(bounds)
    document = np.repeat(np.arange(len(counts)), counts)

    longest = longest_repeats(document * max(1, len(coded.dictionary)) + codes, np.repeat(bounds[1:], counts))
    peak = np.zeros(len(counts), dtype=np.int64)
    np.maximum.at(peak, document, longest)
    data, offsets = text_bytes(texts)
    doubled = []
    for text in texts.to_pylist():
        lines = [line for line in text.split("\n") if line.strip(_SPACE)]
        doubled.append(len(lines) - len(set(lines)))
    return {
        "n_words": counts,
        "word_chars": _sum_by(chars[codes], bounds),
        "n_symbols": np.diff(np.searchsorted(np.flatnonzero(_IS_SYMBOL[data]), offsets)),
        "n_dup_lines": np.array(doubled, dtype=np.int64),
        "n_repeat_words": _sum_by(_covered(longest, 3, 3), bounds),
        "covered_words": _sum_by(_covered(longest, min_repeat), bounds),
        "longest_repeat": peak,
    }


_COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_words", "longest_repeat"]


def _measures(min_repeat: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text", SLICE_BYTES):
                found = measure(part.column(1), min_repeat)
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(found[c].astype(np.int64)) for c in _COLUMNS)], ["doc_id", *_COLUMNS])

    return run


def repetition(
    docs: DataFrame,
    *,
    min_words: int = 50,
    max_repeat_percent: int = 50,
    min_repeat: int = MIN_REPEAT,
    max_covered: float = MAX_COVERED,
    max_longest: int = MAX_LONGEST,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per document with its measures, ``base_failed`` and ``kept``.

    ``n_repeat_words`` are words in three-word windows found twice or more, ``covered_words`` words in repeated
    substrings of ``min_repeat`` words or more, ``longest_repeat`` the words of the longest repeated substring.
    ``kept`` is false where the base rules fail (too few words, too many repeated words), where more than
    ``max_covered`` of the words are covered or the longest repeat is above ``max_longest``. A null, empty or blank
    text has no words and fails. Repeated rows and null ids stay. An empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, " + ", ".join(f"{c} long" for c in _COLUMNS)
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    repeats = (F.col("covered_words") > max_covered * F.col("n_words")) | (F.col("longest_repeat") > max_longest)
    small_batches(rows.sparkSession)
    return rows.mapInArrow(frugal(_measures(min_repeat)), schema).withColumns({"base_failed": failed, "kept": ~failed & ~repeats})
