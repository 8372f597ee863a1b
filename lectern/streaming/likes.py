"""Incremental like counts over a stream of interactions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_likes(events: DataFrame, threshold: int = 4, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """Likes per book and tumbling window; events later than `late` behind the newest are dropped.

    events: (ts, book_id, rating), static or streaming.
    """
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return timed.withWatermark("ts", late).where(F.col("rating") >= threshold).groupBy(F.window("ts", window), "book_id").agg(F.count("*").alias("likes")).select(F.col("window.start").alias("window_start"), "book_id", "likes")
