"""Versioned tables: write a new generation, check it, publish it at once, keep the one before; a run log.

Generations live in directories of their own and a small pointer file names the live one.
Readers resolve the pointer, so publishing is one atomic rename whatever the table's size.
"""

from __future__ import annotations

import datetime as dt
import json
import re
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bocage.sources import fs

_NAME = re.compile(r"[a-z][a-z0-9_]{0,62}")
LOG_SCHEMA = "source string, started_at timestamp, finished_at timestamp, status string, row_count long, digest string, phase string, message string, skip_reason string"


@dataclass(frozen=True)
class Store:
    """A folder of versioned tables on a file system all executors share."""

    root: str

    def _pointer(self, name: str) -> str:
        if not _NAME.fullmatch(name):
            raise ValueError(f"bad table name: {name!r}")
        return f"{self.root}/{name}.json"

    def _state(self, spark: SparkSession, name: str) -> dict:
        text = fs.read_text(spark, self._pointer(name))
        return json.loads(text) if text else {"live": None, "previous": None}

    def _point(self, spark: SparkSession, name: str, state: dict) -> None:
        fs.replace_text(spark, self._pointer(name), json.dumps(state), f"{self._pointer(name)}.{uuid.uuid4().hex}")

    def stage(self, df: DataFrame, name: str, sort: tuple[str, ...] = (), partitions: int | None = None) -> str:
        """Write a new generation that nobody reads yet; ``sort`` clusters it so scans can skip files."""
        self._pointer(name)
        path = f"{self.root}/{name}/{uuid.uuid4().hex}"
        if sort:
            df = (df.repartitionByRange(partitions, *sort) if partitions else df.repartitionByRange(*sort)).sortWithinPartitions(*sort)
        df.write.parquet(path)
        return path

    def publish(self, spark: SparkSession, name: str, path: str) -> None:
        """Make a staged generation the live one; the live one becomes the previous."""
        before = self._state(spark, name)
        self._point(spark, name, {"live": path, "previous": before["live"], "published_at": dt.datetime.now(dt.UTC).isoformat()})

    def read(self, spark: SparkSession, name: str, generation: str = "live") -> DataFrame:
        path = self._state(spark, name)[generation]
        if path is None:
            raise LookupError(f"{name} has no {generation} generation")
        return spark.read.parquet(path)

    def rollback(self, spark: SparkSession, name: str) -> None:
        """Make the previous generation live again."""
        state = self._state(spark, name)
        if state["previous"] is None:
            raise LookupError(f"{name} has no previous generation")
        self.publish(spark, name, state["previous"])

    def drop_stale(self, spark: SparkSession, name: str, days: int, now: dt.datetime) -> str:
        """Drop the previous generation once the live one is old enough: absent, no_history, kept or dropped."""
        state = self._state(spark, name)
        if state["live"] is None:
            return "absent"
        if state["previous"] is None:
            return "no_history"
        if (now - dt.datetime.fromisoformat(state["published_at"])).days < days:
            return "kept"
        # First nobody finds it any more, then it goes.
        self._point(spark, name, {**state, "previous": None})
        fs.remove(spark, state["previous"])
        return "dropped"

    def log(self, spark: SparkSession, **entry) -> None:
        """Append one run to the log."""
        columns = [c.split()[0] for c in LOG_SCHEMA.split(", ")]
        spark.createDataFrame([tuple(entry.get(c) for c in columns)], LOG_SCHEMA).write.mode("append").parquet(f"{self.root}/run_log")

    def runs(self, spark: SparkSession) -> DataFrame:
        path = f"{self.root}/run_log"
        return spark.read.parquet(path) if fs.exists(spark, path) else spark.createDataFrame([], LOG_SCHEMA)

    def unchanged(self, spark: SparkSession, source: str, digest: str) -> bool:
        """Whether the last successful run of a source loaded the same bytes."""
        last = self.runs(spark).where((F.col("source") == source) & (F.col("status") == "success")).agg(F.max_by("digest", "finished_at").alias("d")).first()
        return last["d"] == digest
