"""Session helpers shared by every operator: tables, checkpoints, bucket counts."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def build_session(app: str = "bocage", **conf: str) -> SparkSession:
    """A session with the settings the operators assume: UTC, ANSI, AQE."""
    builder = SparkSession.builder.appName(app)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship_package(spark: SparkSession) -> None:
    """Give the workers this package where they would not find it by themselves, once per application."""
    context, home = spark.sparkContext, Path(__file__).resolve().parent
    known = {os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p}
    if getattr(context, "_bocage_shipped", False) or str(home.parent) in known:
        return
    folder = tempfile.mkdtemp(prefix="bocage-code-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    with zipfile.ZipFile(os.path.join(folder, "bocage.zip"), "w") as archive:
        for source in sorted(home.rglob("*.py")):
            archive.write(source, source.relative_to(home.parent))
    context.addPyFile(os.path.join(folder, "bocage.zip"))
    context._bocage_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a data directory."""
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared folder; a folder of this machine only where all runs on it and none is named."""
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    shared = spark.conf.get(CHECKPOINT_KEY, None) or context.getConf().get(CHECKPOINT_KEY)
    if shared:
        context.setCheckpointDir(shared)
        return
    if not context.master.startswith("local[") and context.master != "local":
        raise RuntimeError(f"name a folder that all executors share in {CHECKPOINT_KEY}")
    own = tempfile.mkdtemp(prefix="bocage-checkpoint-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    context.setCheckpointDir(f"file://{own}")


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage through reliable storage that survives lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder beside the checkpoints, which all executors share."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{purpose}-{uuid.uuid4().hex}"


def bucket_count(rows: int, rows_per_bucket: int) -> int:
    """Buckets that keep a hash bucket near ``rows_per_bucket`` at any input size."""
    return max(1, -(-rows // rows_per_bucket))
