"""Event counts and keep-latest state as Structured Streaming; the same functions run on a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hourly_counts(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """start, event_type, n per hour and kind; a stream drops what comes later than `late`."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events
    return timed.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n")


def latest_values(events: DataFrame) -> DataFrame:
    """user_id, event_id, value: the newest generation (event_id) of each user."""
    return events.groupBy("user_id").agg(F.max(F.struct("event_id", "value")).alias("last")).select("user_id", "last.event_id", "last.value")


#: Kinds of telemetry events; rows of other kinds don't reach the sink.
KINDS = ("signup", "purchase", "click", "view", "country_resolved", "fallback_used", "providers_loaded", "market_changed")


def start_sink(events: DataFrame, path: str, checkpoint: str, kinds: tuple[str, ...] = KINDS):
    """Appends a stream of events to a table of files by kind, each event once, and returns the running query."""
    known = events.where(F.col("event_type").isin(*kinds))
    return known.writeStream.format("parquet").partitionBy("event_type").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
