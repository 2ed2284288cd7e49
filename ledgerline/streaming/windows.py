"""Streaming forms of registry aggregates (an extension: batch is the norm)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily_intake(events: DataFrame, ts: str = "ts", late: str = "2 days") -> DataFrame:
    """Tumbling daily counts with a watermark."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, "1 day")).agg(F.count("*").alias("intake")).select(F.col("window.start").alias("day"), "intake")
