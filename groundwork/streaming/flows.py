"""The row-wise operators over streams, and windows of events with late data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X


def redacted(stream: DataFrame, text: str = "text") -> DataFrame:
    """Injection phrases and personal data removed from each row; works on batches and streams alike."""
    return stream.withColumn(text, X.redact_pii(X.redact_injection(F.col(text)), 1 << 30))


def event_windows(stream: DataFrame, time: str = "ts", width: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Counts and sums of events by type in tumbling windows; rows later than ``late`` are dropped by the watermark."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
