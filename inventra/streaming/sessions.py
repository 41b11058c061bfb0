"""Sessions and windows of unbounded event streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def session_counts(events: DataFrame, gap: str = "30 minutes", lateness: str = "1 hour", ts: str = "ts", key: str = "user_id") -> DataFrame:
    """Sessions of each key; state is dropped once the watermark has passed. Works on a stream and on a table alike."""
    e = events.withColumn(ts, F.col(ts).cast("timestamp"))
    if e.isStreaming:
        e = e.withWatermark(ts, lateness)
    g = e.groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("events"), F.round(F.sum("value"), 4).alias("value"))
    return g.select(key, F.col("w.start").cast("timestamp_ntz").alias("session_start"), F.col("w.end").cast("timestamp_ntz").alias("session_end"), "events", "value")


def distinct_within(events: DataFrame, lateness: str = "1 hour", ts: str = "ts", key: str = "event_id") -> DataFrame:
    """Events without repeats that arrive within the lateness."""
    e = events.withColumn(ts, F.col(ts).cast("timestamp"))
    return e.withWatermark(ts, lateness).dropDuplicatesWithinWatermark([key]) if e.isStreaming else e.dropDuplicates([key])


def run_once(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Processes what is there and stops: an incremental batch whose progress is in the checkpoint."""
    stream.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
