"""Joins and groupings of points, intervals and gaps.

Times are numbers (integer microseconds or samples), so both engines of a comparison agree exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def contained(trials: DataFrame, intervals: DataFrame, key: str, start: str, stop: str, own_start: str, own_stop: str, width: int = 1 << 20) -> DataFrame:
    """Trials that an interval of the same key holds, strictly on both ends: a semi join.

    Trials are dealt out by key and by the bucket of ``width`` in which they start, intervals by all buckets they touch, so a key with a large share of
    the rows spreads; ``width`` should be near the usual interval's length.
    """
    bucket = lambda c: F.floor(F.col(c) / width)
    t = trials.withColumn("bucket", bucket(start)).alias("t")
    i = intervals.where(F.col(own_stop) > F.col(own_start)).withColumn("bucket", F.explode(F.sequence(bucket(own_start), bucket(own_stop)))).alias("i")
    same = (F.col(f"t.{key}") == F.col(f"i.{key}")) & (F.col("t.bucket") == F.col("i.bucket"))
    held = same & (F.col(f"i.{own_start}") < F.col(f"t.{start}")) & (F.col(f"i.{own_stop}") > F.col(f"t.{stop}"))
    return t.join(i, held, "left_semi").select(*trials.columns)


def points_in_intervals(points: DataFrame, intervals: DataFrame, key: str, time: str, start: str, stop: str, width: int) -> DataFrame:
    """Every (point, interval) of one key with start <= time < stop.

    Both sides are dealt out by key and time bucket of ``width``, so a key that holds a large share of the rows
    still spreads, and the join compares a point with the intervals of its bucket only. ``width`` should be near the
    usual interval length: an interval is copied once for each bucket it touches.
    """
    bucket = lambda c: F.floor(F.col(c) / width)
    p = points.withColumn("bucket", bucket(time))
    i = intervals.where(F.col(stop) > F.col(start)).withColumn("bucket", F.explode(F.sequence(bucket(start), F.floor((F.col(stop) - 1) / width))))
    return p.join(i, [key, "bucket"]).where((F.col(time) >= F.col(start)) & (F.col(time) < F.col(stop))).drop("bucket")


def unmatched(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Rows without a partner, to warn about."""
    return left.join(right, on, "left_anti")


def sessions(rows: DataFrame, key: str, start: str, end: str, gap: int, order: list[str] | None = None) -> DataFrame:
    """Adds ``gap`` (start less the end before, 0 at first) and ``session`` (rises where the gap exceeds ``gap``)."""
    w = Window.partitionBy(key).orderBy(start, *(order or []))
    out = rows.withColumn("gap", F.coalesce(F.col(start) - F.lag(end).over(w), F.lit(0)))
    return out.withColumn("session", F.sum((F.col("gap") > gap).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long"))


def long_runs(series: DataFrame, key: str, index: str, value: str, longer_than: int) -> DataFrame:
    """(key, start, stop) of maximal runs of zeros longer than ``longer_than``, half-open."""
    w = Window.partitionBy(key).orderBy(index)
    zeros = series.withColumn("rn", F.row_number().over(w)).where(F.col(value) == 0)
    island = zeros.withColumn("island", F.col("rn") - F.row_number().over(w))
    runs = island.groupBy(key, "island").agg(F.min(index).alias("start"), (F.max(index) + 1).alias("stop"), F.count("*").alias("n"))
    return runs.where(F.col("n") > longer_than).select(key, "start", "stop")


def masked(series: DataFrame, runs: DataFrame, key: str, index: str, weight: str, width: int = 1024) -> DataFrame:
    """``series`` with weight 0 inside the runs, whose ends count as inside. Both sides are dealt out by key and bucket of ``width``."""
    bucket = lambda c: F.floor(F.col(c) / width)
    s = series.select(key, index, bucket(index).alias("bucket")).alias("s")
    r = runs.withColumn("bucket", F.explode(F.sequence(bucket("start"), bucket("stop")))).alias("r")
    inside = (F.col(f"s.{key}") == F.col(f"r.{key}")) & (F.col("s.bucket") == F.col("r.bucket")) & F.col(f"s.{index}").between(F.col("r.start"), F.col("r.stop"))
    quiet = s.join(r, inside, "left_semi").select(key, index).withColumn("quiet", F.lit(True))
    return series.join(quiet, [key, index], "left").withColumn(weight, F.when(F.col("quiet"), 0).otherwise(F.col(weight))).drop("quiet")


def windows_at(events: DataFrame, frames: DataFrame, key: str, index: str, value: str, before: int, length: int) -> DataFrame:
    """(event columns, lag, value): ``length`` frames from ``before`` ahead of each event; frames outside are 0."""
    spread = events.withColumn("lag", F.explode(F.sequence(F.lit(0), F.lit(length - 1)))).withColumn("frame", F.col(index) + F.col("lag") - before)
    right = frames.select(F.col(key), F.col(index).alias("frame"), F.col(value).alias("at"))
    return spread.join(right, [key, "frame"], "left").withColumn(value, F.coalesce("at", F.lit(0))).drop("at", "frame")


def balanced(rows: DataFrame, group: str, tie: Column, least: int, keep_over: int) -> DataFrame:
    """An equal number of rows of each group in the order of ``tie``.

    The number is the smallest group's size; if that is under ``least`` it is ``least``, and groups of
    at most ``keep_over`` rows are dropped.
    """
    sizes = rows.groupBy(group).agg(F.count("*").alias("size"))
    smallest = sizes.agg(F.min("size").alias("smallest"))
    plan = sizes.crossJoin(F.broadcast(smallest))  # one row
    plan = plan.withColumn("take", F.greatest("smallest", F.lit(least))).where((F.col("smallest") >= least) | (F.col("size") > keep_over))
    ranked = rows.join(plan.select(group, "take"), group).withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(tie)))
    return ranked.where("rank <= take").drop("take", "rank")
