"""The folder that a cluster shares, and cutting a plan there."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, made the context's own.

    Where none is named, a session of one process (a local master) gets a temporary one; on a cluster, where a folder of
    one machine would be lost with it, that is a ``ValueError``.
    """
    context = spark.sparkContext
    current = context._jsc.sc().getCheckpointDir()
    named = spark.conf.get("spark.checkpoint.dir", None) or (current.get() if current.isDefined() else None)
    if not named and re.match(r"local($|\[)", context.master):
        named = tempfile.mkdtemp(prefix="tallyloom-")
    if not named:
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not current.isDefined():
        context.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and go on from there: a lost executor costs its tasks only."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
