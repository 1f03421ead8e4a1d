"""Structured Streaming forms of the batch operators: bins, sessions and mergeable sums.

Each takes a streaming or a batch DataFrame with an event time; with a watermark, late rows are dropped as spikes outside the bins are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def binned_counts(events: DataFrame, time: str, key: str, width: str, late: str) -> DataFrame:
    """(key, start, n): tumbling bins."""
    out = events.withWatermark(time, late).groupBy(F.window(time, width), key).agg(F.count("*").alias("n"))
    return out.select(key, F.col("window.start").alias("start"), "n")


def overlapping_means(events: DataFrame, time: str, key: str, value: str, width: str, slide: str, late: str) -> DataFrame:
    """(key, start, mean, n) of overlapping chunks."""
    out = events.withWatermark(time, late).groupBy(F.window(time, width, slide), key).agg(F.avg(value).alias("mean"), F.count("*").alias("n"))
    return out.select(key, F.col("window.start").alias("start"), "mean", "n")


def sessions(events: DataFrame, time: str, key: str, gap: str, late: str) -> DataFrame:
    """(key, start, stop, n): sessions that end after a gap."""
    out = events.withWatermark(time, late).groupBy(F.session_window(time, gap), key).agg(F.count("*").alias("n"))
    return out.select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("stop"), "n")


def running_moments(events: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """Mergeable sums by key for regression as rows arrive (complete or update mode)."""
    a, b = F.col(x), F.col(y)
    return events.groupBy(key).agg(F.count("*").alias("n"), F.sum(a).alias("sx"), F.sum(b).alias("sy"), F.sum(a * a).alias("sxx"), F.sum(a * b).alias("sxy"), F.sum(b * b).alias("syy"))
