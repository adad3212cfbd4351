"""JSON-lines records with rejects, dataset hashes, images, predictions, manifests and configurations."""

from __future__ import annotations

import hashlib
import io
import json
import math
from collections.abc import Iterator
from dataclasses import fields, is_dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom import schema as S
from tallyloom.functions.text import canonical_json
from tallyloom.operators.validate import record_errors
from tallyloom.sources.png import DamagedImage, decode

#: Question types as data files name them, and as they are named here.
TYPE_NAMES = {"noul": S.BINARY, "choice": S.CHOICE, "score": S.ORDINAL, **{t: t for t in S.TYPES}}
#: Lines, and characters of them, whose records stand in a task's memory together.
PARSED_ROWS, PARSED_CHARACTERS = 256, 1 << 20
_TOP = {"schema_version", "id", "group_id", "task_family", "language", "state", "image_path", "question", "target", "provenance"}
_REQUIRED = _TOP - {"image_path"}
_PROVENANCE = {f.name for f in S.PROVENANCE.fields}


def parse_json_strict(text: str):
    """JSON without non-finite numbers and without repeated keys at any depth; otherwise a ``ValueError``."""

    def unique(pairs):
        out = dict(pairs)
        if len(out) != len(pairs):
            raise ValueError("repeated_key")
        return out

    def finite(name: str):
        raise ValueError("not_finite")

    def number(text: str) -> float:
        value = float(text)
        if not math.isfinite(value):
            raise ValueError("not_finite")
        return value

    return json.loads(text, parse_constant=finite, parse_float=number, object_pairs_hook=unique)


def state_depth(value) -> int:
    """Levels of containers around the deepest value."""
    deepest, waiting = 0, [(value, 0)]
    while waiting:
        here, depth = waiting.pop()
        deepest = max(deepest, depth)
        if isinstance(here, dict):
            waiting += [(v, depth + 1) for v in here.values()]
        elif isinstance(here, list):
            waiting += [(v, depth + 1) for v in here]
    return deepest


def _strict(value, kind: type) -> bool:
    return type(value) is kind


def parse_record(line: str) -> tuple[dict | None, list[str]]:
    """A line to a record of schema ``EXAMPLE``, or the codes of what is wrong with its form.

    The schema is closed and strict: unknown or missing keys and values of another type are errors. Rules that need no
    parsing are left to ``record_errors``.
    """
    if not line.strip():
        return None, ["blank_line"]
    try:
        raw = parse_json_strict(line)
    except (ValueError, RecursionError) as error:
        return None, [str(error) if str(error) in ("repeated_key", "not_finite") else "not_json"]
    if not isinstance(raw, dict):
        return None, ["not_an_object"]
    errors = [f"unknown_{k}" for k in sorted(raw.keys() - _TOP)] + [f"missing_{k}" for k in sorted(_REQUIRED - raw.keys())]
    text = lambda v: v is None or _strict(v, str)
    for key in ("id", "group_id", "task_family", "language", "image_path"):
        if not text(raw.get(key)):
            errors.append(f"type_{key}")
    if not _strict(raw.get("schema_version"), int):
        errors.append("type_schema_version")
    state, kind = raw.get("state"), None
    if isinstance(state, str):
        kind, state = "text", state.replace("\r\n", "\n").replace("\r", "\n")
    elif isinstance(state, dict | list):
        kind = "object" if isinstance(state, dict) else "array"
        if state_depth(state) > S.MAX_DEPTH:
            errors.append("state_depth")
        state = canonical_json(state)
    else:
        errors.append("type_state")
    question, target, provenance = raw.get("question"), raw.get("target"), raw.get("provenance")
    asked: dict = {}
    if isinstance(question, dict):
        asked = {"type": TYPE_NAMES.get(question.get("type")) if _strict(question.get("type"), str) else None, "instructions": question.get("instructions"), "options": None, "levels": None}
        if asked["type"] is None:
            errors.append("question_type")
        if not text(asked["instructions"]):
            errors.append("type_instructions")
        criteria = question.get("criteria")
        allowed = {"type", "instructions"} | ({"criteria"} if asked["type"] != S.BINARY else set())
        errors += [f"unknown_question_{k}" for k in sorted(question.keys() - allowed)]
        if asked["type"] == S.CHOICE:
            if isinstance(criteria, dict) and all(_strict(v, str) for v in criteria.values()):
                asked["options"] = [{"id": k, "description": v} for k, v in criteria.items()]
            else:
                errors.append("type_criteria")
        elif asked["type"] == S.ORDINAL:
            if isinstance(criteria, list) and all(_strict(v, str) for v in criteria):
                asked["levels"] = criteria
            else:
                errors.append("type_criteria")
    else:
        errors.append("type_question")
    aimed = {"label": None, "class_id": None, "level_index": None}
    if isinstance(target, dict):
        errors += [f"unknown_target_{k}" for k in sorted(target.keys() - aimed.keys())]
        for key, want in (("label", int), ("class_id", str), ("level_index", int)):
            if key in target:
                fits = _strict(target[key], want) and (want is str or -(2**31) <= target[key] < 2**31)
                aimed[key] = target[key] if fits else None
                errors += [] if fits else [f"type_{key}"]
    else:
        errors.append("type_target")
    origin = dict.fromkeys(_PROVENANCE)
    if isinstance(provenance, dict):
        errors += [f"unknown_provenance_{k}" for k in sorted(provenance.keys() - _PROVENANCE)]
        for key in _PROVENANCE & provenance.keys():
            fits = provenance[key] is None or _strict(provenance[key], int if key == "seed" else str)
            origin[key] = provenance[key] if fits else None
            errors += [] if fits else [f"type_provenance_{key}"]
    else:
        errors.append("type_provenance")
    if errors:
        return None, errors
    kept = {k: raw.get(k) for k in ("schema_version", "id", "group_id", "task_family", "language", "image_path")}
    return kept | {"state": state, "state_kind": kind, "question": asked, "target": aimed, "provenance": origin}, []


def _runs(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Where runs of at most PARSED_ROWS lines of about PARSED_CHARACTERS begin and end; a longer line stands alone."""
    start = held = 0
    for i, size in enumerate(sizes):
        if i > start and (i - start >= PARSED_ROWS or held + size > PARSED_CHARACTERS):
            yield start, i
            start, held = i, 0
        held += size
    if sizes:
        yield start, len(sizes)


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for whole in batches:
        for start, end in _runs(whole["value"].fillna("").str.len().tolist()):
            batch = whole.iloc[start:end]
            made = [parse_record(line) for line in batch["value"].fillna("")]
            yield pd.DataFrame({"path": batch["path"].array, "line": batch["line"].array, "value": batch["value"].array, "record": [r for r, _ in made], "form_errors": [e for _, e in made]})


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``path, line, value`` of text files; lines count from 1 within each file.

    The reader keeps a file's order within a split; splits of a file are numbered by where they begin, so line numbers
    are sums over the splits before, without gathering lines.
    """
    from pyspark.sql import Window

    raw = spark.read.option("lineSep", "\n").text(path).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("order"))
    counts = raw.groupBy("path", "block").agg(F.count("*").alias("n"), F.min("order").alias("first"))
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("path", "block", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    joined = raw.join(F.broadcast(offsets), ["path", "block"])  # one row per file split
    return joined.select("path", (F.col("before") + F.col("order") - F.col("first") + 1).alias("line"), "value")


def read_examples(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Valid examples (schema ``EXAMPLE``) and rejects ``path, line, value, errors`` of JSON-lines files."""
    schema = T.StructType(
        [T.StructField("path", T.StringType()), T.StructField("line", T.LongType()), T.StructField("value", T.StringType()), T.StructField("record", S.EXAMPLE), T.StructField("form_errors", T.ArrayType(T.StringType()))]
    )
    parsed = read_lines(spark, path).mapInPandas(_parse, schema)
    flat = parsed.select("path", "line", "value", "form_errors", "record.*")
    judged = flat.withColumn("errors", F.when(F.size("form_errors") > 0, F.col("form_errors")).otherwise(record_errors()))
    good = judged.where(F.size("errors") == 0).select([f.name for f in S.EXAMPLE.fields])
    return good, judged.where(F.size("errors") > 0).select("path", "line", "value", "errors")


def load_examples(spark: SparkSession, path: str) -> DataFrame:
    """Examples of files without a single reject; otherwise a ``ValueError`` names the first ones."""
    good, rejects = read_examples(spark, path)
    if first := rejects.orderBy("path", "line").limit(20).collect():
        raise ValueError("rejected lines: " + "; ".join(f"{r.path}:{r.line} {','.join(r.errors)}" for r in first))
    return good


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """``path, bytes, sha256`` of whole files, to be compared with a manifest."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def check_declared(files: DataFrame, declared: dict[str, str]) -> None:
    """Every declared file name must be there with its hash."""
    found = {r.path.rsplit("/", 1)[-1]: r.sha256 for r in files.collect()}
    if wrong := sorted(n for n, h in declared.items() if found.get(n) != h):
        raise ValueError(f"files that differ from the manifest: {wrong}")


def bounded(body: Column, most: int) -> Column:
    """The body, or null if it takes more than ``most`` bytes."""
    return F.when(F.octet_length(body) <= most, body)


def decode_base64(text: Column, most: int = S.MAX_IMAGE_BYTES) -> Column:
    """Strict base64 within a bound; null for anything else."""
    return bounded(F.try_to_binary(text, F.lit("base64")), most)


def image_format(content: Column) -> Column:
    """``png`` or ``jpg`` by the leading bytes, else null."""
    head = F.hex(F.substring(content, 1, 8))
    return F.when(head == "89504E470D0A1A0A", "png").when(head.startswith("FFD8FF"), "jpg")


def _png_size(content: bytes) -> tuple[int, int] | None:
    return (int.from_bytes(content[16:20]), int.from_bytes(content[20:24])) if content[12:16] == b"IHDR" and len(content) >= 24 else None


def _jpg_size(content: bytes) -> tuple[int, int] | None:
    at = 2
    while at + 9 < len(content) and content[at] == 0xFF:
        if 0xC0 <= content[at + 1] <= 0xCF and content[at + 1] not in (0xC4, 0xC8, 0xCC):
            return int.from_bytes(content[at + 7 : at + 9]), int.from_bytes(content[at + 5 : at + 7])
        at += 2 + int.from_bytes(content[at + 2 : at + 4])
    return None


def image_error(name: str, content: bytes) -> str | None:
    """What is wrong with an image: its size, format, pixels, animation, its name, which is the content's hash, or its data.

    PNG files are decoded whole. JPEG files are only where Pillow is; elsewhere they are ``undecoded``, never sound.
    """
    if len(content) > S.MAX_IMAGE_BYTES:
        return "bytes"
    png, jpg = content.startswith(b"\x89PNG\r\n\x1a\n"), content.startswith(b"\xff\xd8\xff")
    if not png and not jpg:
        return "format"
    size = _png_size(content) if png else _jpg_size(content)
    if size is None or not all(size):
        return "damaged"
    if size[0] * size[1] > S.MAX_IMAGE_PIXELS:
        return "pixels"
    if png and b"acTL" in content[: content.find(b"IDAT")]:
        return "animated"
    stem, _, ending = name.rpartition("/")[2].rpartition(".")
    if hashlib.sha256(content).hexdigest() != stem:
        return "hash"
    if ending not in (("png",) if png else ("jpg", "jpeg")):
        return "ending"
    if png:
        try:
            decode(content, S.MAX_IMAGE_PIXELS)
        except DamagedImage:
            return "damaged"
        return None
    try:
        from PIL import Image
    except ModuleNotFoundError:
        return "undecoded"
    try:
        Image.open(io.BytesIO(content)).convert("RGB")
    except Exception:  # any decoder's error means the same
        return "damaged"
    return None


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """``path, bytes, sha256, error`` of image files; a null error means that the image is sound, decoded whole."""
    files = spark.read.format("binaryFile").load(path).select("path", "length", "content")

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"path": b["path"], "bytes": b["length"], "sha256": [hashlib.sha256(c).hexdigest() for c in b["content"]], "error": [image_error(p, c) for p, c in zip(b["path"], b["content"])]})

    return files.mapInPandas(check, "path string, bytes long, sha256 string, error string")


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(S.PREDICTION).option("mode", "FAILFAST").json(path)


def load_config(cls: type, text: str):
    """A dataclass from JSON text (or YAML, if its reader is installed): closed, with every value of the declared type."""
    try:
        raw = parse_json_strict(text)
    except ValueError:
        import yaml

        raw = yaml.safe_load(text)
    return _build(cls, raw)


def _build(cls: type, raw: dict):
    from typing import get_type_hints

    if not isinstance(raw, dict):
        raise ValueError(f"{cls.__name__} is an object")
    hints, names = get_type_hints(cls), {f.name for f in fields(cls)}
    if unknown := sorted(raw.keys() - names):
        raise ValueError(f"unknown settings: {unknown}")
    made = {}
    for name, value in raw.items():
        kind = hints[name]
        if is_dataclass(kind):
            value = _build(kind, value)
        elif isinstance(kind, type) and not (type(value) is kind or (kind is float and type(value) is int)):
            raise ValueError(f"{name} is {kind.__name__}")
        made[name] = value
    return cls(**made)
