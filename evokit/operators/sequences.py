"""Operators along a series: smoothing, lags, differences, peaks and event designs.

Series are long: one row a (key, index). Lags and kernels are small tables of a stated length, so a join with them
multiplies rows by that length only; the work is equi-joins on (key, index) and sums that combine before the shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hann(n: int) -> list[float]:
    """Symmetric Hann window with zero ends, of sum one."""
    raw = [0.5 - 0.5 * math.cos(2 * math.pi * k / (n - 1)) for k in range(n)]
    return [v / sum(raw) for v in raw]


def smooth(series: DataFrame, key: str, index: str, value: str, kernel: list[float], shift: int = 0, width: int = 4096) -> DataFrame:
    """Centred convolution with zeros outside ('same'); ``shift`` 1 gives the value one sample ahead.

    The series must hold every index of a key; the kernel becomes window offsets. A series is cut into runs of ``width``
    with the few samples beyond either end that the kernel reaches, so one long series is many groups.
    """
    half = len(kernel) // 2
    steps = [half - k + shift for k in range(len(kernel))]
    run = lambda far: F.floor((F.col(index) - far) / width)
    rows = series.withColumn("run", F.explode(F.sequence(run(max(0, *steps)), run(min(0, *steps)))))
    w = Window.partitionBy(key, "run").orderBy(index)
    terms: Column | None = None
    for step, h in zip(steps, kernel, strict=True):
        at = F.col(value) if step == 0 else F.lead(value, step).over(w) if step > 0 else F.lag(value, -step).over(w)
        part = F.lit(h) * F.coalesce(at, F.lit(0))
        terms = part if terms is None else terms + part
    return rows.withColumn("smooth", terms).where(F.col("run") == run(0)).drop("run")


def padded(clip: Column, before: int, length: int) -> Column:
    """A clip, an array, with ``before`` zeros ahead, then zeros up to ``length`` or cut there."""
    whole = F.concat(F.array_repeat(F.lit(0.0), before), clip, F.array_repeat(F.lit(0.0), length))
    return F.slice(whole, 1, length)


def delay_embedding(series: DataFrame, key: str, index: str, value: str, delays: Iterable[int]) -> DataFrame:
    """Adds x_k, the value k samples before (null at the start)."""
    w = Window.partitionBy(key).orderBy(index)
    return series.withColumns({f"x_{k}": F.lag(value, k).over(w) if k else F.col(value) for k in delays})


def lag_products(left: DataFrame, right: DataFrame, index: str, lags: range, keep: list[str], product: Column) -> DataFrame:
    """(keep..., lag, s, n): sum and number of ``product`` over pairs (t, t + lag); columns l.* and r.* are the sides.

    The shorter side is copied once a lag and joined on the shifted index.
    """
    spread = left.alias("l").withColumn("lag", F.explode(F.sequence(F.lit(lags.start), F.lit(lags.stop - 1), F.lit(1)))).withColumn("at", F.col(f"l.{index}") + F.col("lag"))
    pairs = spread.join(right.alias("r"), F.col("at") == F.col(f"r.{index}"))
    return pairs.groupBy(*keep, "lag").agg(F.sum(product).alias("s"), F.count("*").alias("n"))


def first_difference(series: DataFrame, key: str, index: str, value: str) -> DataFrame:
    return series.withColumn("diff", F.lead(value).over(Window.partitionBy(key).orderBy(index)) - F.col(value))


def local_maxima(series: DataFrame, key: str, index: str, value: str, height: float) -> DataFrame:
    """Strict local maxima of at least ``height``."""
    w = Window.partitionBy(key).orderBy(index)
    peak = (F.lag(value).over(w) < F.col(value)) & (F.lead(value).over(w) < F.col(value)) & (F.col(value) >= height)
    return series.withColumn("peak", F.coalesce(peak, F.lit(False))).where("peak").drop("peak")


def plateau_peaks(series: DataFrame, key: str, index: str, value: str, height: float) -> DataFrame:
    """(key, index, value): maxima of at least ``height``; a flat top counts once, at its middle (the earlier of two). Ends of a series are no peaks."""
    w = Window.partitionBy(key).orderBy(index)
    flat = series.withColumn("change", F.coalesce((F.col(value) != F.lag(value).over(w)).cast("int"), F.lit(1)))
    flat = flat.withColumn("top", F.sum("change").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    tops = flat.groupBy(key, "top").agg(F.min(index).alias("a"), F.max(index).alias("z"), F.min(value).alias(value))
    w = Window.partitionBy(key).orderBy("top")
    peak = (F.lag(value).over(w) < F.col(value)) & (F.lead(value).over(w) < F.col(value)) & (F.col(value) >= height)
    return tops.withColumn("peak", F.coalesce(peak, F.lit(False))).where("peak").select(key, F.floor((F.col("a") + F.col("z")) / 2).alias(index), value)


def onset_offset_events(series: DataFrame, key: str, index: str, value: str, height: float) -> DataFrame:
    """(key, index, onset, offset, value): peaks of the rise are onsets, those of the fall offsets, each as a share of the key's highest of its kind."""
    diff = first_difference(series, key, index, value).where("diff is not null")
    kinds = [plateau_peaks(diff.withColumn("diff", sign * F.col("diff")), key, index, "diff", height).withColumn("onset", F.lit(onset)) for sign, onset in ((1, 1), (-1, 0))]
    events = kinds[0].unionByName(kinds[1])
    top = events.groupBy(key, "onset").agg(F.max("diff").alias("top"))
    return events.join(top, [key, "onset"]).select(key, index, "onset", (1 - F.col("onset")).alias("offset"), (F.col("diff") / F.col("top")).alias("value"))


def pruned_peaks(peaks: DataFrame, key: str, index: str, value: str, distance: int) -> DataFrame:
    """Peaks at least ``distance`` apart: the highest first removes its neighbours (ties: the later one stays).

    The choice depends only on peaks nearer than ``distance``, so a key's peaks are cut into runs wherever two
    neighbours are ``distance`` apart, and each run is one group, however long the key's series.
    """
    w = Window.partitionBy(key).orderBy(index)
    runs = peaks.withColumn("cut", F.coalesce((F.col(index) - F.lag(index).over(w) >= distance).cast("int"), F.lit(0)))
    runs = runs.withColumn("run", F.sum("cut").over(w.rowsBetween(Window.unboundedPreceding, 0))).select(key, "run", index, value)

    def prune(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(index)
        at, keep = g[index].to_numpy(), np.ones(len(g), bool)
        for i in np.argsort(g[value].to_numpy(), kind="stable")[::-1]:
            if keep[i]:
                near = np.abs(at - at[i]) < distance
                near[i] = False
                keep[near] = False
        return g[keep]

    return runs.groupBy(key, "run").applyInPandas(prune, runs.schema).drop("run")


def impulse_design(events: DataFrame, key: str, kind: str, index: str, value: Column, points: int, frames: int | Column) -> DataFrame:
    """(key, kind, t, k, x): the sparse design in which event ``kind`` acts k samples after its index, for t < frames."""
    spread = events.withColumn("v", value).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).withColumn("t", F.col(index) + F.col("k"))
    return spread.where(F.col("t") < frames).groupBy(key, kind, "t", "k").agg(F.sum("v").alias("x"))


def laguerre(t: Column, order: int, tau: float, alpha: float) -> Column:
    """exp(-t / tau) (t / tau)^alpha L_order^(alpha)(t / tau), as the closed sum."""
    x = t / F.lit(tau)
    total: Column = F.lit(0.0)
    for i in range(order + 1):
        c = (-1) ** i * math.gamma(order + alpha + 1) / (math.gamma(order - i + 1) * math.gamma(alpha + i + 1) * math.factorial(i))
        total = total + F.lit(c) * F.pow(x, F.lit(float(i)))
    return F.exp(-x) * F.pow(x, F.lit(float(alpha))) * total


def gaussians(t: Column, m1: float, s1: float, a1: float, m2: float, s2: float, a2: float) -> Column:
    """A difference of two Gaussians."""
    bell = lambda m, s: F.exp(-0.5 * F.pow((t - F.lit(m)) / F.lit(s), F.lit(2.0)))
    return F.lit(a1) * bell(m1, s1) - F.lit(a2) * bell(m2, s2)


def basis_features(events: DataFrame, basis: DataFrame, key: str, kind: str, index: str, value: str, frames: int | Column) -> DataFrame:
    """(key, kind, order, t, x): events convolved with each basis function; ``basis`` has (order, k, b) and is small."""
    spread = events.join(F.broadcast(basis)).withColumn("t", F.col(index) + F.col("k")).where(F.col("t") < frames)
    return spread.groupBy(key, kind, "order", "t").agg(F.sum(F.col(value) * F.col("b")).alias("x"))


def convolve(series: DataFrame, kernel: DataFrame, key: str, index: str, value: str) -> DataFrame:
    """(key, t, pred): sum over lags d of w_d x[t - d], zeros outside; ``kernel`` has (d, w) and is small."""
    ahead = series.join(F.broadcast(kernel)).select(key, (F.col(index) + F.col("d")).alias(index), (F.col("w") * F.col(value)).alias("part"))
    sums = ahead.groupBy(key, index).agg(F.sum("part").alias("pred"))
    return series.select(key, index).join(sums, [key, index], "left").withColumn("pred", F.coalesce("pred", F.lit(0.0)))
