"""An extension beyond batch: running sums and maxima over an event stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_maxima(events: DataFrame, width: str = "6 hours", slide: str = "1 hour", late: str = "1 hour", value: str = "value", ts: str = "ts", by: str = "event_type") -> DataFrame:
    """Sum and largest value per sliding window; rows later than ``late`` are left out."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width, slide), by).agg(F.sum(value).alias("total"), F.max(value).alias("largest")).select(by, F.col("window.start").alias("start"), F.col("window.end").alias("stop"), "total", "largest")


def running_maxima(events: DataFrame, value: str = "value", by: str = "event_type") -> DataFrame:
    """Largest value so far per key."""
    return events.groupBy(by).agg(F.max(value).alias("largest"))
