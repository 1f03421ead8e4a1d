"""Peri-event time histograms with ragged trials.

A bin is the half-even rounding of a spike's offset by the bin's length; its weight is the number of
trials that last as long, and its rate is count by weight (the bare count where no trial lasts).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bin_of(offset: Column, width: int) -> Column:
    return F.bround(offset / F.lit(float(width)), 0).cast("int")


def bin_grid(trials: DataFrame, key: str, bins: int) -> DataFrame:
    return trials.select(key).distinct().select(key, F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))


def weights(trials: DataFrame, key: str, start: str, stop: str, width: int, bins: int) -> DataFrame:
    """(key, bin, weight): trials with length / width >= bin.

    Trials are counted by their last bin first and summed from the right, so no trial is multiplied by bins.
    """
    last = F.least(F.floor((F.col(stop) - F.col(start)) / F.lit(float(width))), F.lit(bins - 1)).cast("int")
    ends = trials.where(F.col(stop) >= F.col(start)).groupBy(key, last.alias("bin")).agg(F.count("*").alias("n"))
    w = Window.partitionBy(key).orderBy(F.col("bin").desc()).rowsBetween(Window.unboundedPreceding, 0)
    return bin_grid(trials, key, bins).join(ends, [key, "bin"], "left").select(key, "bin", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("weight"))


def histogram(aligned: DataFrame, trials: DataFrame, key: str, offset: str, start: str, stop: str, width: int, bins: int) -> DataFrame:
    """(key, bin, n_spikes, weight, rate) for every bin of every key with a trial; every spike of every trial counts."""
    counts = aligned.select(key, bin_of(F.col(offset), width).alias("bin")).where(F.col("bin") < bins).groupBy(key, "bin").agg(F.count("*").alias("n_spikes"))
    out = weights(trials, key, start, stop, width, bins).join(counts, [key, "bin"], "left").withColumn("n_spikes", F.coalesce("n_spikes", F.lit(0)))
    rate = F.when(F.col("weight") > 0, F.col("n_spikes") / F.col("weight")).otherwise(F.col("n_spikes").cast("double"))
    return out.withColumn("rate", rate)


def binary_mean(aligned: DataFrame, trials: DataFrame, key: str, trial: str, offset: str, width: int, bins: int) -> DataFrame:
    """(key, bin, mean): the share of trials with a spike in the bin; a bin counts once a trial."""
    hits = aligned.select(key, trial, bin_of(F.col(offset), width).alias("bin")).where(F.col("bin") < bins).distinct().groupBy(key, "bin").agg(F.count("*").alias("hits"))
    n = trials.groupBy(key).agg(F.count("*").alias("n_trials"))
    return hits.join(n, key).select(key, "bin", (F.col("hits") / F.col("n_trials")).alias("mean"))
