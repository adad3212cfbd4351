"""Numbered snapshots of a run's state in a shared folder, with a pointer to the last whole one."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import SparkSession

from tallyloom.sources.sinks import read_text

KEPT = 2


def put_text(spark: SparkSession, folder: str, name: str, text: str) -> None:
    """Write a small file whole under another name; one rename then puts it in the place of ``name``, whatever was there."""
    jvm, configuration = spark._jvm, spark._jsc.hadoopConfiguration()
    part, where = (jvm.org.apache.hadoop.fs.Path(f"{folder}/{n}") for n in (f"_{name}", name))
    files = where.getFileSystem(configuration)
    stream = files.create(part, True)
    stream.write(bytearray(text.encode()))
    stream.close()
    over = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    over[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), configuration).rename(files.makeQualified(part), files.makeQualified(where), over)


class Snapshots:
    """``save`` writes ``snapshot-N.json`` and then moves ``LATEST`` to it in one rename; older ones but the last go.

    A run that dies in between leaves the pointer at the snapshot before. ``run`` is the digest of what the state belongs
    to; a snapshot of another run, or one whose content doesn't have its checksum, is refused.
    """

    def __init__(self, spark: SparkSession, folder: str, run: str) -> None:
        self.spark, self.folder, self.run, self.number = spark, folder.rstrip("/"), run, 0

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _put(self, name: str, text: str) -> None:
        put_text(self.spark, self.folder, name, text)

    def begin(self) -> None:
        """Forget earlier runs of the folder."""
        where = self._path("")
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)
        self.number = 0

    def note(self, told: dict) -> None:
        """What stays the same for the whole run."""
        self._put("run.json", json.dumps({"run": self.run, **told}))

    def noted(self) -> dict:
        text = read_text(self.spark, f"{self.folder}/run.json")
        if text is None:
            raise ValueError(f"no run to go on with in {self.folder}")
        told = json.loads(text)
        if told["run"] != self.run:
            raise ValueError("the snapshots are of another run: its parameters or data differ")
        return told

    def save(self, state: dict) -> int:
        """Save ``state``; returns its number."""
        self.number += 1
        text = json.dumps(state, allow_nan=False)
        self._put(f"snapshot-{self.number:08d}.json", text)
        self._put("LATEST", json.dumps({"number": self.number, "sha256": hashlib.sha256(text.encode()).hexdigest(), "run": self.run}))
        old = self._path(f"snapshot-{self.number - KEPT:08d}.json")
        old.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(old, False)
        return self.number

    def latest(self) -> dict | None:
        """The state that ``LATEST`` points to, or None before the first."""
        self.noted()
        pointer = read_text(self.spark, f"{self.folder}/LATEST")
        if pointer is None:
            return None
        told = json.loads(pointer)
        text = read_text(self.spark, f"{self.folder}/snapshot-{told['number']:08d}.json")
        if told["run"] != self.run or text is None or hashlib.sha256(text.encode()).hexdigest() != told["sha256"]:
            raise ValueError("the last snapshot is of another run or damaged")
        self.number = told["number"]
        return json.loads(text)
