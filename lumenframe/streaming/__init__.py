"""Compositions over streams: an extension, as the annotation pipeline itself has no streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, *, time: str = "ts", kind: str = "event_type", window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, kind, n, total) by window, for a stream or a table; events later than late are left out of a stream."""
    return events.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), kind).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), kind, "n", "total")
