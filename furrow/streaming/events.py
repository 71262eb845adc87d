"""Windowed counts of an event stream: an extra, as the reference has no streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed(events: DataFrame, at: str, by: str, value: str, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """(by, start, n, mean) of tumbling windows; with a stream, rows later than the watermark are left out."""
    timed = events.withColumn(at, F.col(at).cast("timestamp"))
    if events.isStreaming:
        timed = timed.withWatermark(at, late)
    return timed.groupBy(F.window(at, width).alias("w"), by).agg(F.count("*").alias("n"), F.avg(value).alias("mean")).select(
        by, F.col("w.start").alias("start"), "n", "mean"
    )
