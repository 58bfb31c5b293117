"""Rate limits: counts in fixed windows, as a batch over what happened, or as a stream with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def counts(events: DataFrame, key: str, at: str = "ts", window: str = "1 minute", late: str | None = None) -> DataFrame:
    """(window_start, key, n, expires): requests in each fixed window; a record expires two windows after it began. With ``late``
    a streaming frame drops a window's state that long after its end."""
    df = events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late) if late else events
    grouped = df.groupBy(F.window(at, window).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return grouped.select(F.col("w.start").alias("window_start"), key, "n", (F.col("w.end") + (F.col("w.end") - F.col("w.start"))).alias("expires"))


def decisions(events: DataFrame, key: str, limit: int, at: str = "ts", window: str = "1 minute", *tie: str) -> DataFrame:
    """Each event with ``allowed`` and ``remaining`` of its window."""
    w = events.withColumn("window_start", F.window(at, window)["start"])
    nth = F.row_number().over(Window.partitionBy(key, "window_start").orderBy(at, *tie))
    return w.withColumn("nth", nth).withColumn("allowed", F.col("nth") <= limit).withColumn("remaining", F.greatest(F.lit(0), F.lit(limit) - F.col("nth")))
