"""Windowed monitor of events; the same rows in batch and streaming.

Streams allow no distinct aggregate, so there a window's state holds the set of its users.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed(events: DataFrame, width: str = "1 hour") -> DataFrame:
    """Events, users and total value by window and type. With a stream, rows leave when the watermark passes."""
    if events.isStreaming:
        events = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "10 minutes")
    users = F.size(F.collect_set("user_id")) if events.isStreaming else F.countDistinct("user_id")
    out = events.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), users.alias("users"), F.round(F.sum("value"), 2).alias("total"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", "users", "total")
