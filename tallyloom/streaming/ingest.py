"""Streaming counterparts (beyond the reference, which is batch only): an append-only store fed by a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def new_only(stream: DataFrame, fingerprint: str = "print", event_time: str = "seen_at", delay: str = "30 days") -> DataFrame:
    """First sightings by fingerprint; state older than the watermark is dropped."""
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark([fingerprint])


def attention_windows(stream: DataFrame, event_time: str, key: str, value: str, width: str = "7 days", slide: str = "1 day", delay: str = "2 days") -> DataFrame:
    """Sliding windows of attention with late data up to ``delay``."""
    return stream.withWatermark(event_time, delay).groupBy(F.window(event_time, width, slide), key).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("value"))


def append_store(stream: DataFrame, folder: str, checkpoint: str):
    """Write accepted rows to the Parquet store, exactly once; returns the query, which ends when the input does."""
    return stream.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
