"""Recursive filters over long series as an associative scan.

A cascade of second-order sections is one linear system with a small state. A series is dealt into chunks; each chunk, a task's row, gives the state that it
would leave behind if it began at rest. What a chunk passes on is that plus a fixed matrix times what it gets, so the states are chained over one
short row a chunk, and each chunk then runs once more from the state that it really gets. A channel, however long, is many rows; the samples are
shuffled once.

The index of a series counts 0, 1, 2...; before 0 everything is at rest. Defined results: rows without a key or index, or with an index under 0, take no part; a
null or NaN value counts as 0, and so does a sample that is not there, which gets no row; of samples that share an index the least is taken; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evokit.session import scratch_path

#: Samples of a chunk, and of the blocks that are one matrix product in it; the first is a multiple of the second.
CHUNK, STEP = 1 << 16, 64


def notch_section(frequency: float, rate: float, quality: float = 30.0) -> np.ndarray:
    """(1, 6) b0 b1 b2 a0 a1 a2 of a second-order notch."""
    w = 2 * math.pi * frequency / rate
    gain = 1 / (1 + math.tan(w / quality / 2))
    return np.array([[gain, -2 * gain * math.cos(w), gain, 1.0, -2 * gain * math.cos(w), 2 * gain - 1]])


def butterworth(order: int, rate: float, low: float | None = None, high: float | None = None) -> np.ndarray:
    """Sections of a Butterworth filter: band-pass between ``low`` and ``high``, high-pass above ``low`` or low-pass under ``high``, of gain 1 where it passes."""
    edges = [f for f in (low, high) if f is not None]
    if not edges or edges != sorted(set(edges)) or not 0 < edges[0] <= edges[-1] < rate / 2:
        raise ValueError("a band lies between 0 and half the rate")
    warp = lambda f: 2 * rate * math.tan(math.pi * f / rate)
    poles = np.exp(1j * math.pi * (2 * np.arange(order) + order + 1) / (2 * order))
    if low is not None and high is not None:
        half, centre = poles * (warp(high) - warp(low)) / 2, warp(low) * warp(high)
        root = np.sqrt(half**2 - centre)
        poles, at, zeros = np.concatenate((half + root, half - root)), 2 * math.atan(math.sqrt(centre) / (2 * rate)), (1.0, -1.0)
    elif low is not None:
        poles, at, zeros = warp(low) / poles, math.pi, (1.0, 1.0)
    else:
        poles, at, zeros = warp(high) * poles, 0.0, (-1.0, -1.0)
    z = (2 * rate + poles) / (2 * rate - poles)
    upper = sorted((p for p in z if p.imag > 1e-12), key=lambda p: abs(p))
    real = sorted((p.real for p in z if abs(p.imag) <= 1e-12), key=abs)
    pairs = [(-2 * p.real, abs(p) ** 2) for p in upper] + [(-(a + b), a * b) for a, b in zip(real[::2], real[1::2], strict=False)]
    sections = [[1.0, -(zeros[0] + zeros[1]), zeros[0] * zeros[1], 1.0, a1, a2] for a1, a2 in pairs]
    if len(real) % 2:
        sections.append([1.0, -zeros[0], 0.0, 1.0, -real[-1], 0.0])
    out = np.array(sections)
    point = np.exp(-1j * at * np.arange(3))
    gains = abs((out[:, :3] @ point) / (out[:, 3:] @ point))
    out[:, :3] /= gains[:, None]
    return out


def state_space(sections: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """(A, B, C, D) of a cascade: s' = A s + B x, y = C s + D x, two states a section."""
    n = 2 * len(sections)
    a, b, c, d = np.zeros((n, n)), np.zeros(n), np.zeros(n), 1.0
    for k, (b0, b1, b2, a0, a1, a2) in enumerate(sections / sections[:, 3:4]):
        at = slice(2 * k, 2 * k + 2)
        into = np.array([b1 - a1 * b0, b2 - a2 * b0])  # of the section's own input
        a[at, at] = [[-a1, 1.0], [-a2, 0.0]]
        a[at, :] += np.outer(into, c)
        b[at] = into * d
        c *= b0
        c[2 * k] += 1.0
        d *= b0
    return a, b, c, d


class Steps:
    """A system over blocks of ``STEP`` samples: outputs and the next state as matrix products."""

    def __init__(self, sections: np.ndarray):
        a, b, c, d = state_space(sections)
        powers = [np.eye(len(a))]
        for _ in range(STEP):
            powers.append(powers[-1] @ a)
        self.leap = powers[STEP]
        self.seen = np.array([c @ p for p in powers[:STEP]])  # what a state adds to each output
        self.kept = np.array([powers[STEP - 1 - u] @ b for u in range(STEP)]).T  # what each input leaves in the state
        self.now = np.zeros((STEP, STEP))
        answer = np.array([d, *(self.seen[:-1] @ b)])
        for u in range(STEP):
            self.now[u, : u + 1] = answer[u::-1]

    def run(self, x: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(outputs, state at the end of the last whole block and its zeros) for samples from ``state`` on."""
        blocks = np.zeros((-(-len(x) // STEP), STEP))
        blocks.ravel()[: len(x)] = x
        left, states = blocks @ self.kept.T, np.empty((len(blocks), len(state)))
        for k in range(len(blocks)):
            states[k] = state
            state = self.leap @ state + left[k]
        return (blocks @ self.now.T + states @ self.seen.T).ravel()[: len(x)], state


def filtered(series: DataFrame, key: str, index: str, value: str, sections: np.ndarray, chunk: int | None = None) -> DataFrame:
    """(key, i, value): each series run through the sections in order."""
    spark, size = series.sparkSession, chunk or CHUNK
    if size % STEP:
        raise ValueError(f"a chunk is a multiple of {STEP} samples")
    kind = series.schema[key].dataType.simpleString()
    v = F.coalesce(F.nanvl(F.col(value).cast("double"), F.lit(0.0)), F.lit(0.0))
    own = series.where(F.col(key).isNotNull() & (F.col(index) >= 0)).select(F.col(key).alias("s"), F.floor(F.col(index) / size).alias("chunk"), F.struct((F.col(index) % size).cast("int").alias("u"), v.alias("v")).alias("x"))
    path = scratch_path(spark, "chunks")
    own.groupBy("s", "chunk").agg(F.array_sort(F.collect_list("x")).alias("x")).select("s", "chunk", F.col("x.u").alias("u"), F.col("x.v").alias("v")).write.parquet(path)
    chunks = spark.read.parquet(path)
    steps = Steps(sections)
    n, leap = len(steps.leap), np.linalg.matrix_power(steps.leap, size // STEP)

    def samples(u: np.ndarray, v: np.ndarray, length: int) -> np.ndarray:
        x = np.zeros(length)
        x[u[::-1]] = v[::-1]  # the first of equal indices stays
        return x

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            states = [steps.run(samples(b.column("u")[k].values.to_numpy(), b.column("v")[k].values.to_numpy(), size), np.zeros(n))[1] for k in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([b.column("s"), b.column("chunk"), pa.array(states, pa.list_(pa.float64()))], names=["s", "chunk", "state"])

    def chain(g: pd.DataFrame) -> pd.DataFrame:
        # A row a chunk.
        g = g.sort_values("chunk")
        out, state, at = [], np.zeros(n), 0
        for c, left in zip(g["chunk"], g["state"], strict=True):
            state = np.linalg.matrix_power(leap, int(c - at)) @ state  # chunks that are not there
            out.append(state)
            state, at = leap @ state + left, c + 1
        return pd.DataFrame({"s": g["s"], "chunk": g["chunk"], "state": out})

    begin = chunks.mapInArrow(ends, f"s {kind}, chunk long, state array<double>").groupBy("s").applyInPandas(chain, f"s {kind}, chunk long, state array<double>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                u, v = b.column("u")[k].values.to_numpy(), b.column("v")[k].values.to_numpy()
                y, _ = steps.run(samples(u, v, int(u[-1]) + 1), np.array(b.column("state")[k].as_py()))
                u = np.unique(u)
                yield pa.RecordBatch.from_arrays([b.column("s").take(pa.array([k] * len(u))), pa.array(u + b.column("chunk")[k].as_py() * size, pa.int64()), pa.array(y[u])], names=[key, "i", "value"])

    return chunks.join(begin, ["s", "chunk"]).select("s", "chunk", "u", "v", "state").mapInArrow(run, f"{key} {kind}, i long, value double")


def zero_phase(series: DataFrame, key: str, index: str, value: str, sections: np.ndarray, chunk: int | None = None) -> DataFrame:
    """(key, i, value): filtered forwards and then backwards from the last sample, at rest beyond either end."""

    def turned(df: DataFrame) -> DataFrame:
        return df.join(last, key).select(key, (F.col("last") - F.col("i")).alias("i"), "value")

    there = filtered(series, key, index, value, sections, chunk)
    last = series.where(F.col(index) >= 0).groupBy(key).agg(F.max(index).cast("long").alias("last"))
    return turned(filtered(turned(there), key, "i", "value", sections, chunk))


def envelope(series: DataFrame, key: str, index: str, value: str, above: np.ndarray, band: np.ndarray, chunk: int | None = None) -> DataFrame:
    """(key, i, value): the size of what passes ``above``, less its mean, smoothed by ``band``; both without a shift in time."""
    high = zero_phase(series, key, index, value, above, chunk)
    mean = high.groupBy(key).agg(F.avg("value").alias("mean"))
    return zero_phase(high.join(mean, key).select(key, "i", F.abs(F.col("value") - F.col("mean")).alias("value")), key, "i", "value", band, chunk)
