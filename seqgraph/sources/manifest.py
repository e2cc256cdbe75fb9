"""Runs and their phases as small JSON files in a shared folder: what a run reads, how far it came, whether it may go on."""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The order of phases for a two-pass build (a filter, exact counts) and for a one-pass build.
TWO_PASS, ONE_PASS = ("candidates", "exact", "finalizing", "complete"), ("counting", "complete")
_RUN = "run string, seq long, at double, event string, phase string, identity string, config string"


class InputChanged(ValueError):
    """The input or the settings aren't those that the run began with."""


def identity(spark: SparkSession, paths: list[str], settings: dict) -> str:
    """What a run depends on: path, size and modification time of each input file, and the settings."""
    hadoop, found = spark._jvm.org.apache.hadoop.fs, []
    for p in paths:
        path = hadoop.Path(p)
        for s in path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path):
            found.append([s.getPath().toString(), s.getLen(), s.getModificationTime()])
    return json.dumps({"files": sorted(found), "settings": settings}, sort_keys=True)


class Run:
    """One run of a job: an append-only log of events, each a file of its own, so that writers never meet."""

    def __init__(self, spark: SparkSession, folder: str, name: str, phases: tuple[str, ...]):
        self.spark, self.folder, self.name, self.phases = spark, folder.rstrip("/"), name, phases

    def _write(self, event: str, phase: str | None, identity_: str | None, config: dict | None) -> None:
        n = len(self.log())
        row = {"run": self.name, "seq": n, "at": time.time(), "event": event, "phase": phase, "identity": identity_, "config": json.dumps(config) if config is not None else None}
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{self.name}/{n:08d}-{uuid.uuid4().hex}.json")
        stream = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).create(path, False)
        stream.write(bytearray(json.dumps(row).encode()))
        stream.close()

    def log(self) -> list[dict]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{self.name}")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return []
        return [r.asDict() for r in self.spark.read.schema(_RUN).json(str(path)).orderBy("seq", "at").collect()]

    def start(self, identity_: str, config: dict | None = None) -> str:
        """Begins or resumes; returns the phase to go on with. Another input than the first one's is an error."""
        log = self.log()
        if not log:
            self._write("start", self.phases[0], identity_, config or {})
            return self.phases[0]
        if log[0]["identity"] != identity_:
            raise InputChanged(self.name)
        return log[-1]["phase"]

    def advance(self) -> str:
        """Ends the current phase; the next one is returned. A complete run stays complete."""
        now = self.log()[-1]["phase"]
        at = self.phases.index(now)
        if at + 1 < len(self.phases):
            now = self.phases[at + 1]
            self._write("finish" if now == self.phases[-1] else "phase", now, None, None)
        return now


def runs(spark: SparkSession, folder: str) -> DataFrame:
    """run, started, finished (null while it goes on), phase, config of every run in a folder."""
    log = spark.read.schema(_RUN).json(f"{folder.rstrip('/')}/*")
    return log.groupBy("run").agg(F.min("at").alias("started"), F.max(F.when(F.col("event") == "finish", F.col("at"))).alias("finished"), F.max_by("phase", "seq").alias("phase"), F.min_by("config", "seq").alias("config"))


def labelled(rows: DataFrame, phase: str) -> DataFrame:
    """Rows of a table that can be read while it is built, with whether they are whole."""
    return rows.withColumn("coverage_state", F.lit("complete" if phase == "complete" else "partial"))
