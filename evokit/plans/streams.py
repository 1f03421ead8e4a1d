"""Streaming queries, run over the table events as a bounded stream until it is used up."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evokit.catalog import query
from evokit.session import scratch_path
from evokit.streaming import products, windows


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    # A file source reads a folder; the pattern also names a single file or a folder of parts.
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(f"{sf_dir}/events.parquet*")
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def _drained(spark: SparkSession, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Runs the stream to its end in update mode; the last state of each group by ``keys``.

    Each batch writes the groups it changed under its number in the shared folder, so a repeated batch replaces its own rows,
    and Spark drops the state of windows that the watermark has passed.
    """
    path, check = scratch_path(spark, "stream"), scratch_path(spark, "stream-state")
    q = rows.writeStream.foreachBatch(lambda df, i: df.write.mode("overwrite").parquet(f"{path}/batch={i}")).option("checkpointLocation", check).outputMode("update").trigger(availableNow=True).queryName(f"q{uuid.uuid4().hex}").start()
    q.awaitTermination()
    others = [c for c in rows.columns if c not in keys]
    return spark.read.parquet(path).groupBy(*keys).agg(F.max_by(F.struct(*others), "batch").alias("x")).select(*keys, "x.*")


@query("SELECT event_type, epoch_us(date_trunc('hour', ts)) AS start_us, count(*) AS n FROM events GROUP BY 1, 2")
def stream_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly counts by type from the stream."""
    out = _drained(spark, windows.binned_counts(_stream(spark, sf_dir), "ts", "event_type", "1 hour", "1 hour"), ["event_type", "start"])
    return out.select("event_type", F.unix_micros("start").alias("start_us"), "n")


@query("SELECT event_type, count(*) AS n, round(sum(value), 2) AS sy, sum(user_id)::BIGINT AS sx FROM events GROUP BY 1")
def stream_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums by type as state of the stream."""
    out = _drained(spark, windows.running_moments(_stream(spark, sf_dir), "event_type", "user_id", "value"), ["event_type"])
    return out.select("event_type", "n", F.round("sy", 2).alias("sy"), F.col("sx").cast("long").alias("sx"))


@query("""WITH g AS (SELECT user_id, epoch_us(ts) AS t, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS gap FROM events),
s AS (SELECT user_id, t, sum((gap IS NULL OR gap > 21600000000)::INT) OVER (PARTITION BY user_id ORDER BY t) AS s FROM g) SELECT user_id, min(t) AS start_us, max(t) + 21600000000 AS stop_us, count(*) AS n FROM s GROUP BY user_id, s""")
def session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of six hours by the session window, over the batch table."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    return windows.sessions(e, "ts", "user_id", "6 hours", "1 hour").select("user_id", F.unix_micros("start").alias("start_us"), F.unix_micros("stop").alias("stop_us"), "n")


@query("SELECT event_type, count(*) AS n, sum(user_id)::BIGINT AS sx, sum(round(value * 100)::BIGINT)::BIGINT AS sy, sum(user_id * user_id)::BIGINT AS sxx, sum(user_id * round(value * 100)::BIGINT)::BIGINT AS sxy FROM events WHERE value IS NOT NULL GROUP BY 1")
def stream_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products of users and values by type as state with a timer: the sums when the stream is used up. Values are whole cents, so the sums don't depend on batches."""
    rows = _stream(spark, sf_dir).withColumn("cents", F.round(F.col("value") * 100))
    out = _drained(spark, products.running_products(rows, "ts", "event_type", "user_id", "cents", "1 day", 1000 * 86400 * 3650), ["event_type"])
    return out.select("event_type", *(F.col(c).cast("long").alias(c) for c in ("n", "sx", "sy", "sxx", "sxy")))
