"""Line deduplication against counting in Python and against SQL."""

import hashlib
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from tallyloom.llm.lines import LineRuns, dedup_batch, dedup_lines, line_keys
from tallyloom.llm.queries import ORACLES, op5_dedup_lines
from tests.llm.conftest import SMALL

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def slow(rows, min_docs, min_chars):
    """``[(doc_id, kept text, lines, dropped)]``; every row is a document."""
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    holders = defaultdict(set)
    for i, (_, text) in enumerate(rows):
        for line in (text or "").split("\n"):
            if len(key(line)) >= min_chars:
                holders[key(line)].add(i)
    least = lambda d: float("-inf") if d is None else d
    last = {k: max(least(rows[i][0]) for i in own) for k, own in holders.items() if len(own) >= min_docs}
    out = []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        kept = [line for line in lines if key(line) not in last or least(doc_id) >= last[key(line)]]
        out.append((doc_id, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


LONG = "This line is quite long and found in many places."
ROWS = [
    (1, f"{LONG}\nown one"),
    (2, f"  {LONG.upper()} \t\n{LONG}"),
    (3, f"{LONG}\r\nshort\nshort"),
    (4, LONG),
    (4, f"{LONG}\nanother row of the same id"),
    (None, f"{LONG}\nonly where no id is: aaaaaaaaaaaaaaaaaaaa"),
    (None, "only where no id is: aaaaaaaaaaaaaaaaaaaa"),
    (5, None),
    (6, ""),
    (7, "\n\n"),
    (8, "ÀÉ line of accents that stays as it is, long enough"),
    (9, "àé line of accents that stays as it is, long enough"),
    (10, "word " * 50_000 + "\n" + LONG[:20]),
]


def spread(df):
    return sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in df.collect()), key=str)


@pytest.mark.parametrize("broadcast_keys", [0, 100])
@pytest.mark.parametrize("min_docs", [2, 5])
def test_against_counting(spark, min_docs, broadcast_keys):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("gone", "hi", "lo", "last", "n", "holder")})
    # Rows of one id have lists of their own lines only with keys sent to the tasks; joined by id, they share one.
    out = dedup_lines(docs, min_docs=min_docs, min_chars=40, broadcast_keys=broadcast_keys)
    assert spread(out) == sorted(slow(ROWS, min_docs, 40), key=str)


def test_the_query_against_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SMALL}/documents.parquet'")
    expected = sorted(con.sql(f"SELECT doc_id, n_lines, n_dropped, kept_sha256 FROM ({ORACLES['op5_dedup_lines']})").fetchall())
    assert sorted(map(tuple, op5_dedup_lines(spark, SMALL).collect())) == expected


def test_the_query_against_counting(spark, small_rows):
    rows = [(d, t) for d, t in zip(small_rows["doc_id"].tolist(), small_rows["text"].tolist())]
    expected = sorted((d, n, gone, hashlib.sha256(text.encode()).hexdigest()) for d, text, n, gone in slow(rows, 5, 40))
    assert sorted(map(tuple, op5_dedup_lines(spark, SMALL).collect())) == expected


def test_runs_are_compacted_and_counts_kept(spark):
    runs = LineRuns(spark, fanout=2, buckets=3)
    for batch in range(5):
        docs = spark.createDataFrame([(batch * 10 + i, f"line number {i % 3} of some length\nown line of {batch}, {i}") for i in range(4)], "doc_id long, text string")
        runs.add(line_keys(docs, 5))
    assert [len(level) for level in runs.levels] == [1, 0, 1]  # five runs: one of four, one of one
    merged = runs.merged().collect()
    assert len(merged) == 3 + 20
    assert sorted(r.n for r in merged)[-3:] == [5, 5, 10]
    names = runs.tables()
    runs.drop()
    assert not any(spark.catalog.tableExists(t) for t in names)


def test_batches_lose_what_earlier_ones_hold(spark):
    runs = LineRuns(spark, fanout=2, buckets=3)
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    first = dedup_batch(runs, frame([(1, f"{LONG}\nfirst own line of this text here, longish"), (2, LONG)]))
    assert spread(first) == [(1, f"{LONG}\nfirst own line of this text here, longish", 2, 0), (2, LONG, 1, 0)]
    second = dedup_batch(runs, frame([(3, f"{LONG.upper()}\nsomething else that is new in this batch"), (None, LONG)]))
    assert spread(second) == sorted([(3, "something else that is new in this batch", 2, 1), (None, "", 1, 1)], key=str)
    third = dedup_batch(runs, frame([(4, "something else that is new in this batch\n" + LONG), (5, None)]))
    assert spread(third) == [(4, "", 2, 2), (5, "", 1, 0)]
    runs.drop()


def test_awkward_rows_and_an_empty_table(awkward, nothing):
    out = dedup_lines(awkward, min_docs=2, min_chars=1).toPandas()
    assert len(out) == 12 and out["text"].notna().all()
    assert dedup_lines(nothing).count() == 0
