"""Split manifests: written once, and verified in full whenever they are read."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator, Sequence
from itertools import combinations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom import schema as S
from tallyloom.operators.split import assign_groups
from tallyloom.sources.sinks import read_text, write_manifest

FORMAT = 1
#: Bytes of lines that are handed on together.
CHUNK = 1 << 20
#: What must not be in two splits, by the column that holds it; a null counts for nothing.
LEAKS = {"group": "group_id", "input": "input_sha256", "serialization": "serialized_sha256", "image": "image_sha256"}
COLUMNS = ("id", *LEAKS.values())


class SplitError(ValueError):
    """A split that doesn't fit its dataset, its plan, or its own rules."""


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines in order, each ended by a line feed, in chunks numbered within the partition."""
    held, size, part, number = [], 0, 0, 0

    def chunk() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([part]), pa.array([number]), pa.array([b"".join(held)], pa.binary())], ["part", "number", "data"])

    for batch in batches:
        for part, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            held.append(line.encode() + b"\n")
            size += len(held[-1])
            if size >= CHUNK:
                yield chunk()
                held, size, number = [], 0, number + 1
    if held:
        yield chunk()


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One digest over all chunks in order; the last line feed is no part of it."""
    made, waiting = hashlib.sha256(), b""
    for batch in batches:
        for data in batch.column(0).to_pylist():
            made.update(waiting)
            waiting = data
    made.update(waiting[:-1])
    yield pa.RecordBatch.from_arrays([pa.array([made.hexdigest()])], ["digest"])


def ordered_digest(lines: DataFrame, order: str, line: str) -> str:
    """SHA-256 of all values of ``line`` joined by line feeds, in ascending code-point order of ``order``, then of the line.

    Ranges are sorted in parallel and packed into chunks; one task then takes the chunks in order through one digest. It
    holds a chunk at a time, and Spark sorts the chunks' numbers with spilling. A null line is an empty one.
    """
    # many rows may share one value of ``order``: ranges are cut by both
    sorted_lines = lines.select(F.col(order).alias("order"), F.coalesce(F.col(line), F.lit("")).alias("line")).repartitionByRange(F.col("order").asc_nulls_first(), "line").sortWithinPartitions(F.col("order").asc_nulls_first(), "line")
    chunks = sorted_lines.select(F.spark_partition_id().cast("long").alias("part"), "line").mapInArrow(_chunks, "part long, number long, data binary")
    digests = chunks.repartition(1).sortWithinPartitions("part", "number").select("data").mapInArrow(_digest, "digest string").collect()
    return digests[0]["digest"] if digests else hashlib.sha256().hexdigest()


def plan_digest(assigned: DataFrame, group: str) -> str:
    """SHA-256 of the lines ``group:split``, by group and joined by line feeds."""
    return ordered_digest(assigned.withColumn("_line", F.concat_ws(":", group, "split")), group, "_line")


def dataset_digest(examples: DataFrame) -> str:
    """SHA-256 of all examples' ids and contents' hashes, by id."""
    line = F.concat_ws("\t", "id", *(F.coalesce(F.col(c), F.lit("-")) for c in COLUMNS[1:]))
    return ordered_digest(examples.withColumn("_line", line), "id", "_line")


def leaks(rows: DataFrame) -> dict[tuple[str, str, str], int]:
    """``{(what, split, split): keys that both hold}`` of rows with ``split``: all kinds and pairs of splits by one shuffle.

    A key's splits are bits of a number, so a hot key is added up where its rows are.
    """
    bit = F.lit(0)
    for i, name in enumerate(S.SPLITS):
        bit = F.when(F.col("split") == name, 1 << i).otherwise(bit)
    keys = F.explode(F.array(*[F.struct(F.lit(what).alias("what"), F.col(column).cast("string").alias("key")) for what, column in LEAKS.items()])).alias("k")
    seen = rows.select(bit.cast("int").alias("bits"), keys).where("k.key IS NOT NULL").groupBy("k.what", "k.key").agg(F.bit_or("bits").alias("bits"))
    counts = {(r["what"], r["bits"]): r["n"] for r in seen.groupBy("what", "bits").agg(F.count("*").alias("n")).collect()}
    out: dict[tuple[str, str, str], int] = {}
    for (what, bits), n in counts.items():
        for i, j in combinations(range(len(S.SPLITS)), 2):
            if bits >> i & 1 and bits >> j & 1:
                pair = (what, S.SPLITS[i], S.SPLITS[j])
                out[pair] = out.get(pair, 0) + n
    return out


def leak_errors(found: dict[tuple[str, str, str], int]) -> list[str]:
    """What leaks, in words; serializations count beyond the inputs that are equal anyway."""
    out = []
    for (what, a, b), n in sorted(found.items()):
        own = n - found.get(("input", a, b), 0) if what == "serialization" else n
        if own > 0:
            out.append(f"{own} {what}s are in {a} and {b}")
    return out


def make_split(spark: SparkSession, examples: DataFrame, seed: int, path: str, *, planned: dict | None = None) -> DataFrame:
    """Assign ``examples``' groups, check them for leaks, and write the manifest to ``path``; returns the rows with ``split``.

    ``examples`` holds ``id, group_id, input_sha256, serialized_sha256, image_sha256`` (the last may be null). The folder
    ``rows`` holds an example's split, the file ``split.json`` what all of it must agree with. An equal manifest may be
    there already; another one, leaks, a null or repeated id, or a plan that the split departs from is an error.
    """
    rows = examples.select(*COLUMNS).join(assign_groups(examples, "group_id", seed), "group_id").select("id", *LEAKS.values(), "split")
    _check_ids(examples)
    if errors := leak_errors(leaks(rows)):
        raise SplitError("; ".join(errors))
    groups = rows.select("group_id", "split").distinct()
    told = {r["split"]: r.asDict() for r in rows.groupBy("split").agg(F.count("*").alias("examples"), F.count_distinct("group_id").alias("groups")).collect()}
    header = {
        "format": FORMAT,
        "seed": seed,
        "ratios": dict(S.SPLIT_RATIOS),
        "dataset_sha256": dataset_digest(examples),
        "assignment_sha256": plan_digest(groups, "group_id"),
        "rows_sha256": _rows_digest(rows),
        "splits": {s: {k: told[s][k] for k in ("examples", "groups")} for s in S.SPLITS},
    }
    _check_plan(header, planned)
    if write_manifest(spark, header, f"{path}/split.json") or read_text(spark, f"{path}/rows/_SUCCESS") is None:
        rows.write.mode("overwrite").parquet(f"{path}/rows")
    return rows


def _rows_digest(rows: DataFrame) -> str:
    return ordered_digest(rows.withColumn("_line", F.concat_ws("\t", "id", "group_id", "input_sha256", "split")), "id", "_line")


def _check_ids(examples: DataFrame) -> None:
    twice = examples.groupBy("id").agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") > 1).alias("twice"), F.count_if(F.col("id").isNull()).alias("none")).first()
    if twice["twice"] or twice["none"]:
        raise SplitError(f"{twice['twice']} ids are repeated, {twice['none']} null")


def _check_plan(header: dict, planned: dict | None) -> None:
    """A dataset that was made for a split declares its ``seed`` and ``assignment_sha256``."""
    if planned and planned.get("seed") != header["seed"]:
        raise SplitError(f"the split has seed {header['seed']}, its plan {planned.get('seed')}")
    if planned and planned.get("assignment_sha256") != header["assignment_sha256"]:
        raise SplitError("the split is another one than planned")


def load_split(spark: SparkSession, examples: DataFrame, path: str, splits: Sequence[str], *, allow_test: bool = False, planned: dict | None = None) -> dict[str, DataFrame]:
    """The examples of ``splits``, after the whole manifest was verified against them; any difference is a ``SplitError``.

    Verified are the format and the splits' names; the dataset's digest; the rows' own digest; that every example has one
    row with its group and input, and every row an example; the groups and examples that each split declares; the plan,
    if there is one; and that no group, input, serialization or image is in two splits.
    """
    if unknown := sorted(set(splits) - set(S.SPLITS)):
        raise SplitError(f"unknown splits: {unknown}")
    if "test" in splits and not allow_test:
        raise SplitError("the test split is for the last measurement only: it needs allow_test")
    text = read_text(spark, f"{path}/split.json")
    if text is None:
        raise SplitError(f"no manifest in {path}")
    header = json.loads(text)
    if header.get("format") != FORMAT or set(header.get("splits", {})) != set(S.SPLITS):
        raise SplitError("another format, or other splits")
    _check_ids(examples)
    if header["dataset_sha256"] != dataset_digest(examples):
        raise SplitError("the manifest is of another dataset")
    rows = spark.read.parquet(f"{path}/rows")
    joined = examples.select(*COLUMNS).alias("e").join(rows.alias("m"), F.col("e.id") == F.col("m.id"), "full_outer")
    one_sided = F.col("e.id").isNull() | F.col("m.id").isNull()
    differ = lambda c: F.count_if(~one_sided & ~F.col(f"e.{c}").eqNullSafe(F.col(f"m.{c}")))
    wrong = joined.agg(F.count_if(F.col("m.id").isNull()).alias("examples without a row"), F.count_if(F.col("e.id").isNull()).alias("rows without an example"), *(differ(c).alias(f"rows with another {c}") for c in LEAKS.values()), F.count_if(~F.coalesce(F.col("m.split").isin(*S.SPLITS), F.lit(False)) & ~one_sided).alias("rows of unknown splits")).first().asDict()
    wrong["repeated rows"] = rows.groupBy("id").count().where("count > 1").count()
    told = {r["split"]: {"examples": r["examples"], "groups": r["groups"]} for r in rows.groupBy("split").agg(F.count("*").alias("examples"), F.count_distinct("group_id").alias("groups")).collect()}
    wrong["splits that hold other groups or examples than declared"] = sum(told.get(s) != header["splits"][s] for s in S.SPLITS)
    if found := {k: v for k, v in wrong.items() if v}:
        raise SplitError(f"the manifest does not fit the dataset: {found}")
    if errors := leak_errors(leaks(rows)):
        raise SplitError("; ".join(errors))
    if header["rows_sha256"] != _rows_digest(rows) or header["assignment_sha256"] != plan_digest(rows.select("group_id", "split").distinct(), "group_id"):
        raise SplitError("the manifest's rows were changed")
    _check_plan(header, planned)
    chosen = rows.select("id", "split")
    return {s: examples.join(chosen.where(F.col("split") == s).select("id"), "id", "left_semi") for s in splits}
