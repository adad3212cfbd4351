"""Writers that never overwrite: derived datasets, manifests, checkpoints of coefficients."""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TIMESTAMPS = ("created", "created_at")


def _file_system(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file's text, or None if there is none."""
    files, where = _file_system(spark, path)
    if not files.exists(where):
        return None
    stream = files.open(where)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file under another name, then rename it; fails if the name is taken meanwhile."""
    files, where = _file_system(spark, path)
    part = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    stream = files.create(part, False)
    stream.write(bytearray(text.encode()))
    stream.close()
    if files.exists(where) or not files.rename(part, where):
        files.delete(part, False)
        raise FileExistsError(path)


def write_manifest(spark: SparkSession, manifest: dict, path: str) -> bool:
    """Write an immutable manifest. False if an equal one (but for its timestamps) is there; another one is an error."""
    old = read_text(spark, path)
    if old is not None:
        plain = lambda m: {k: v for k, v in m.items() if k not in TIMESTAMPS}
        if plain(json.loads(old)) == plain(json.loads(json.dumps(manifest))):
            return False
        raise FileExistsError(f"{path} holds another manifest")
    write_text(spark, path, json.dumps(manifest, ensure_ascii=False, sort_keys=True, indent=1))
    return True


def content_digest(df: DataFrame, ident: str = "id") -> str:
    """A digest of all rows that their order and partitions don't change: rows' hashes added up modulo 2^128, with their number."""
    line = F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256)
    piece = lambda i: F.sum(F.conv(F.substring("h", 1 + 8 * i, 8), 16, 10).cast("decimal(20,0)")).alias(f"s{i}")
    row = df.select(line.alias("h")).agg(F.count("*").alias("n"), *(piece(i) for i in range(4))).first()
    return hashlib.sha256(json.dumps([str(v) for v in row]).encode()).hexdigest()


def write_dataset(df: DataFrame, path: str, *, ident: str = "id", manifest: dict | None = None) -> bool:
    """Write sorted JSON lines and a manifest with their digest. False if the same content is there; other content is an error.

    Rows are dealt by ranges of the id, so that part files are in order one after the other.
    """
    spark = df.sparkSession
    declared = {"rows_digest": content_digest(df, ident), "rows": df.count(), **(manifest or {})}
    beside = f"{path.rstrip('/')}.manifest.json"
    if read_text(spark, beside) is not None:
        return write_manifest(spark, declared, beside)
    df.repartitionByRange(ident).sortWithinPartitions(ident).write.mode("errorifexists").json(path)
    return write_manifest(spark, declared, beside)


def write_predictions(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").json(path)


def save_heads(heads: DataFrame, path: str, meta: dict) -> None:
    """Coefficients (``question_type, weights, bias``) as Parquet with a manifest of their digest; never overwrites."""
    heads.coalesce(1).write.mode("errorifexists").parquet(f"{path}/heads")
    write_manifest(heads.sparkSession, meta | {"heads_digest": content_digest(heads, "question_type")}, f"{path}/manifest.json")


def load_heads(spark: SparkSession, path: str, *, base: str | None = None, dimensions: int | None = None) -> tuple[DataFrame, dict]:
    """Coefficients and manifest; fails if the digest, the base or the dimensions are others than expected."""
    meta = json.loads(read_text(spark, f"{path}/manifest.json") or "{}")
    heads = spark.read.parquet(f"{path}/heads")
    if meta.get("heads_digest") != content_digest(heads, "question_type"):
        raise ValueError("the heads differ from their manifest")
    if base is not None and meta.get("base") != base:
        raise ValueError(f"the heads are of base {meta.get('base')}")
    if dimensions is not None and heads.where(F.size("weights") != dimensions).count():
        raise ValueError("the heads have other dimensions")
    return heads, meta


def save_calibration(spark: SparkSession, temperatures: dict, checkpoint: dict, path: str) -> bool:
    """Temperatures bound to the digest of the heads that they were fitted for."""
    return write_manifest(spark, {"temperatures": temperatures, "heads_digest": checkpoint["heads_digest"]}, path)


def load_calibration(spark: SparkSession, path: str, checkpoint: dict) -> dict:
    stored = json.loads(read_text(spark, path) or "{}")
    if stored.get("heads_digest") != checkpoint["heads_digest"]:
        raise ValueError("the calibration is of other heads")
    return stored["temperatures"]


def guard_calibration(calibration: DataFrame, train: DataFrame, keys: tuple[str, ...] = ("group_id", "model_input")) -> None:
    """Rows that temperatures are fitted or evaluated on share no group and no input with those before."""
    for key in keys:
        if shared := calibration.select(key).intersect(train.select(key)).count():
            raise ValueError(f"{shared} values of {key} are shared")
