"""The same transformations over streams, and windows in event time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def read_events(spark: SparkSession, path: str, per_trigger: int = 1) -> DataFrame:
    """A stream of the Parquet files of a folder."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", per_trigger).parquet(path)


def error_rate(events: DataFrame, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """(start, n, n_errors) by tumbling window; rows later than ``late`` are dropped in a stream."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", width))
    return w.agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("n_errors")).select(F.col("window.start").alias("start"), "n", "n_errors")


def activity(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """(user_id, start, end, n): sessions that end after a gap without events."""
    s = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w"))
    return s.agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def latest(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Events once each, however often they are delivered within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"]) if events.isStreaming else events.dropDuplicates(["event_id"])
