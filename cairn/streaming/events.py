"""Structured Streaming over event files: windows with late data, and incremental document ingestion."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Event files as they come; the time without zone is read as the session's, as a watermark needs it."""
    return spark.readStream.schema(EVENTS).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def windowed(events: DataFrame, length: str = "1 day", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Count and sum by window and type; rows later than the watermark are left out."""
    window = F.window("ts", length, slide) if slide else F.window("ts", length)
    grouped = events.withWatermark("ts", late).groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n"), F.bround(F.sum("value"), 2).alias("total"))
    return grouped.select(F.col("w.start").alias("from_ts"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """A user's events without a pause of ``gap``."""
    grouped = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return grouped.select(F.col("w.start").alias("from_ts"), "user_id", "n")


def run_once(rows: DataFrame, checkpoint: str, to: Callable[[DataFrame, int], None], mode: str = "append") -> StreamingQuery:
    """Take what is there, in batches, then end; a batch that is repeated comes with the same number."""
    query = rows.writeStream.outputMode(mode).foreachBatch(to).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
