"""Parametric kernels, priors and stimulus features.

Fits are of one short kernel (a few hundred points) a group; the groups are Spark's. Features are array expressions.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evokit.operators.regression import Moments


def bounded_fit(f: Callable[[np.ndarray], np.ndarray], y: np.ndarray, start: np.ndarray, low: np.ndarray, high: np.ndarray, rounds: int = 200) -> np.ndarray:
    """Least squares within bounds: damped Gauss-Newton steps, clipped, with numeric derivatives."""
    p, damp = np.clip(start, low, high).astype(float), 1e-2
    r = f(p) - y
    for _ in range(rounds):
        jac = np.empty((len(y), len(p)))
        for k in range(len(p)):
            h = 1e-6 * max(1.0, abs(p[k]))
            h = -h if p[k] + h > high[k] else h
            q = p.copy()
            q[k] += h
            jac[:, k] = (f(q) - y - r) / h
        a, g = jac.T @ jac, jac.T @ r
        for _ in range(12):
            step = np.linalg.lstsq(a + damp * np.diag(np.maximum(np.diag(a), 1e-12)), -g, rcond=None)[0]
            q = np.clip(p + step, low, high)
            s = f(q) - y
            if s @ s < r @ r:
                break
            damp *= 4
        else:
            return p
        done = r @ r - s @ s < 1e-14 * (1 + r @ r)
        p, r, damp = q, s, max(damp / 4, 1e-12)
        if done:
            return p
    return p


def laguerre_curve(t: np.ndarray, amp: float, tau: float, alpha: float, order: int = 0) -> np.ndarray:
    """amp exp(-t / tau) (t / tau)^alpha L_order^(alpha)(t / tau), by the three-term recurrence."""
    x = t / tau
    before, now = np.zeros_like(x), np.ones_like(x)
    for k in range(order):
        before, now = now, ((2 * k + 1 + alpha - x) * now - (k + alpha) * before) / (k + 1)
    return amp * np.exp(-x) * np.power(np.maximum(x, 0), alpha) * now


def gaussian_pair(t: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Parameters: amplitude, mean and width of the bell that is added, the same of the one taken off, and a constant."""
    bell = lambda a, m, s: a * np.exp(-0.5 * ((t - m) / s) ** 2)
    return bell(*p[:3]) - bell(*p[3:6]) + p[6]


def fit_laguerre(t: np.ndarray, y: np.ndarray) -> np.ndarray:
    """amp, tau, alpha of one term, started at the extremum."""
    peak = int(np.argmax(abs(y)))
    top = float(y[peak]) or 1e-6
    tau = max(float(t[peak]) / 2, 0.5)
    bound = 20 * max(abs(top), 1e-6)
    return bounded_fit(lambda p: laguerre_curve(t, *p), y, np.array([top * math.e**2 / 4, tau, 2.0]), np.array([-bound, 0.1, 0.0]), np.array([bound, float(t[-1]) + 1, 12.0]))


def fit_gaussians(t: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The seven parameters of a difference of Gaussians, started at the maximum and the minimum."""
    span = float(t[-1] - t[0]) or 1.0
    size = float(np.ptp(y)) or 1e-6
    start = np.array([max(y.max(), 1e-6), t[int(np.argmax(y))], span / 10, max(-y.min(), 1e-6), t[int(np.argmin(y))], span / 10, 0.0])
    low = np.array([0, t[0], span / 200, 0, t[0], span / 200, -size])
    high = np.array([4 * size, t[-1], span, 4 * size, t[-1], span, size])
    return bounded_fit(lambda p: gaussian_pair(t, p), y, start, low, high)


def fitted(kernels: DataFrame, key: str, lag: str, value: str, fit: Callable[[np.ndarray, np.ndarray], np.ndarray], names: list[str]) -> DataFrame:
    """(key, names...): parameters of each key's kernel."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(lag)
        p = fit(g[lag].to_numpy(float), g[value].to_numpy(float))
        return pd.DataFrame({key: [g[key].iloc[0]], **{n: [float(v)] for n, v in zip(names, p, strict=True)}})

    kind = kernels.schema[key].dataType.simpleString()
    return kernels.select(key, lag, value).groupBy(key).applyInPandas(run, f"{key} {kind}, " + ", ".join(f"{n} double" for n in names))


def smoothness_prior(spark: SparkSession, shape: tuple[int, ...]) -> DataFrame:
    """(i, j, v): the grid's Laplacian in long form, with rows of sum zero; neighbours differ by one in one axis."""
    cells = spark.range(math.prod(shape)).withColumnRenamed("id", "i")
    strides = [math.prod(shape[k + 1 :]) for k in range(len(shape))]
    steps = []
    for size, stride in zip(shape, strides, strict=True):
        place = F.pmod(F.floor(F.col("i") / stride), F.lit(size))
        steps += [F.when(place > 0, F.col("i") - stride), F.when(place < size - 1, F.col("i") + stride)]
    near = cells.select("i", F.explode(F.array_compact(F.array(*steps))).alias("j")).withColumn("v", F.lit(-1.0))
    own = near.groupBy("i").agg(F.count("*").cast("double").alias("v")).select("i", F.col("i").alias("j"), "v")
    return near.unionByName(own)


def laplacian(shape: tuple[int, ...]) -> np.ndarray:
    """The same as a matrix, for a prior of a few thousand weights."""
    at = {p: k for k, p in enumerate(itertools.product(*map(range, shape)))}
    out = np.zeros((len(at), len(at)))
    for p, k in at.items():
        for axis in range(len(shape)):
            for d in (-1, 1):
                q = at.get((*p[:axis], p[axis] + d, *p[axis + 1 :]))
                if q is not None:
                    out[k, q], out[k, k] = -1, out[k, k] + 1
    return out


def prior_path(train: Moments, stop: Moments, prior: np.ndarray, first: float = 2e6, last: float = 0.1) -> list[tuple[float, float, np.ndarray]]:
    """(lambda, error on the stopping set, weights) as the prior's weight is halved from ``first`` to ``last``."""
    c, b, mx, my = train.centred()
    out, lam = [], first
    while lam > last:
        h = np.linalg.lstsq(c + lam * prior, b, rcond=None)[0]
        out.append((lam, stop.squared_error(h, float(my - mx @ h)) / stop.weight, h))
        lam /= 2
    return out


def gabor(size: int, angle: float, frequency: float, phase: float, width: float = 0.3) -> np.ndarray:
    """A Gabor patch of size by size on the unit square."""
    u = (np.arange(size) + 0.5) / size - 0.5
    x, y = np.meshgrid(u, u, indexing="ij")
    return np.exp(-0.5 * (x**2 + y**2) / width**2) * np.cos(2 * np.pi * frequency * (x * np.cos(angle) + y * np.sin(angle)) + phase)


def dot(vector: str, weights: np.ndarray) -> Column:
    """The product of an array column with fixed weights."""
    fixed = F.array(*(F.lit(float(w)) for w in weights.ravel()))
    return F.aggregate(F.zip_with(vector, fixed, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, v: s + v)


def gabor_energy(frames: DataFrame, vector: str, size: int, angles: int, frequencies: tuple[float, ...]) -> DataFrame:
    """Adds g_<angle>_<frequency>: the quadrature energy of each patch of the bank."""
    new = {}
    for k in range(angles):
        for j, f in enumerate(frequencies):
            a, b = (dot(vector, gabor(size, math.pi * k / angles, f, phase)) for phase in (0.0, math.pi / 2))
            new[f"g_{k}_{j}"] = F.sqrt(a * a + b * b)
    return frames.withColumns(new)


def modulation_power(windows: DataFrame, key: str, vector: str, rows: int) -> DataFrame:
    """(key, power): two-dimensional modulation power of each window, an array read as ``rows`` rows."""

    def run(batches):
        for pdf in batches:
            power = [(abs(np.fft.fft2(np.asarray(v, float).reshape(rows, -1))) ** 2).ravel() for v in pdf[vector]]
            yield pd.DataFrame({key: pdf[key], "power": power})

    return windows.select(key, vector).mapInPandas(run, f"{key} {windows.schema[key].dataType.simpleString()}, power array<double>")


def poisson_times(units: DataFrame, unit: str, rate_max: float, duration: float, rate: Callable[[Column], Column], seed: int) -> DataFrame:
    """(unit, t): an inhomogeneous Poisson train by thinning; draws are hashes of (unit, number, seed), so tasks may be run again.

    A homogeneous train has exponential gaps, so its times are running sums of a unit's own few draws. Units are dealt out before they have
    draws, so all tasks share the work; a unit's draws stay in its row, and are never shuffled or sorted.
    """
    n = max(1, math.ceil(rate_max * duration + 6 * math.sqrt(rate_max * duration)))
    draw = lambda u, i, salt: (F.pmod(F.xxhash64(u, i, F.lit(seed), F.lit(salt)), F.lit(1 << 53)) + 0.5) / float(1 << 53)
    gaps = F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: -F.log(draw(F.col(unit), i, 1)) / rate_max)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = b.column(1).flatten().to_numpy().reshape(-1, n)
            for k in range(0, len(t), max(1, (1 << 20) // n)):  # about a million times in a batch
                own = t[k : k + max(1, (1 << 20) // n)].cumsum(axis=1)
                ends = pa.array(np.arange(len(own) + 1) * n, pa.int32())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(k, len(own)), pa.ListArray.from_arrays(ends, own.ravel())], names=["unit", "t"])

    dealt = units.repartition(int(units.sparkSession.conf.get("spark.sql.shuffle.partitions")), unit).select(F.col(unit).alias("unit"), gaps.alias("gap"))
    times = dealt.mapInArrow(run, f"unit {units.schema[unit].dataType.simpleString()}, t array<double>")
    spread = times.select("unit", F.posexplode("t").alias("i", "t")).where(F.col("t") < duration)
    return spread.where(draw(F.col("unit"), F.col("i"), 2) * rate_max < rate(F.col("t"))).select(F.col("unit").alias(unit), "t")
