"""Event streams: deduplication under a watermark, windowed counts, sessions, and last value per key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, folder: str, files_per_trigger: int = 4, pattern: str = "*.parquet") -> DataFrame:
    """The Parquet files of a folder whose names fit the pattern, as a stream with a bounded intake per trigger."""
    reader = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_trigger)
    return reader.option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").parquet(folder)


def once(df: DataFrame, key: str = "event_id", ts: str = "ts", delay: str = "1 day") -> DataFrame:
    """Each key once; state older than the watermark is dropped."""
    return df.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def windowed_counts(df: DataFrame, size: str = "1 day", ts: str = "ts", delay: str = "1 day") -> DataFrame:
    """Counts and sums by tumbling window and type; late rows within the delay still count."""
    return df.withWatermark(ts, delay).groupBy(F.window(ts, size), "event_type").agg(
        F.count("*").alias("n"), F.sum("value").alias("total")
    ).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(df: DataFrame, gap: str = "30 minutes", ts: str = "ts", delay: str = "1 day") -> DataFrame:
    """Sessions of users: runs of events no further apart than the gap."""
    return df.withWatermark(ts, delay).groupBy(F.session_window(ts, gap).alias("s"), "user_id").agg(
        F.count("*").alias("n")
    ).select("user_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def run_available(df: DataFrame, folder: str, mode: str = "append", keys: list[str] | None = None) -> DataFrame:
    """Process what is there as a stream; the result is kept, with the stream's own checkpoint, under ``folder``.

    Complete results replace those of the trigger before, appended ones add up.  In ``update`` mode
    each trigger writes only the rows that changed, and the last version of each of the ``keys``
    holds, so state beyond the watermark is dropped and no trigger writes the whole result.
    """
    spark, out = df.sparkSession, f"{folder}/result"
    write = df.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True)
    if mode == "update":
        # A trigger run again writes the same folder again.
        query = write.foreachBatch(lambda batch, i: batch.write.mode("overwrite").parquet(f"{out}/trigger={i}")).start()
        query.awaitTermination()
        written = spark.read.schema(T.StructType([*df.schema.fields, T.StructField("trigger", T.LongType())])).parquet(out)
        rest = [c for c in df.columns if c not in keys]
        return written.groupBy(*keys).agg(F.max_by(F.struct(*rest), "trigger").alias("_r")).select(*[F.col(c) if c in keys else F.col("_r")[c].alias(c) for c in df.columns])
    if mode == "complete":
        query = write.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(out)).start()
    else:
        query = write.format("parquet").option("path", out).start()
    query.awaitTermination()
    return spark.read.schema(df.schema).parquet(out)
