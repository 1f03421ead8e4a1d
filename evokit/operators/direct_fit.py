"""Filters over bands and lags by the direct fit: lagged products, Hermitian systems by frequency, delete-one filters, choice by prediction.

A response is the sum over bands and delays of a filter times the stimulus that long before. Frames are dealt once into blocks
of a set with the frames beyond either end that lags and windows reach, and written; everything else is sums over blocks:

* products of bands by lag, a row of bands at a time, added up by set; a left-out set's are the total less its own;
* their spectra, a row a band, and a system of all bands a (left-out set, frequency), solved in a group of its own;
* filters back in lags, a row a (left-out set, band), with their deviations over left-out sets;
* each set predicted block by block by the filters that were fitted without it, for all tolerances and sparsenesses at once.

Nothing that grows with frames, bands, sets or lags is collected: the driver gets the bands' means, the largest norm and one score a grid
point. A row holds the products of one band with all bands over the lags; a group a system of bands^2, the filters of one band for all sets, or a set's kernels.

Defined results: frames without a set or index take no part; a stimulus with a null in it, or of another length, is the mean stimulus, a null response 0, and either gives its frame the
weight 0, as a null or negative weight does; frames that are not there likewise; of frames that share an index the least by (stimulus, response, weight) is taken; fewer than three
sets raise an error, as deviations without a set need two others; an empty table raises the same.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evokit.operators import spectral
from evokit.session import cut, scratch_path

TOLERANCES = (0.1, 0.05, 0.01, 0.005, 1e-3, 5e-4, 1e-4, 5e-5)
SPARSENESSES = (0.0, 1.0, 2.0, 6.0)
#: Frames of a block, without those beyond its ends.
BLOCK = 2048
#: Sums of products that a task holds before it hands them on.
HELD_BYTES = 1 << 26
#: All kernels of a fit, if they are sent to every task.
BROADCAST_BYTES = 1 << 26
ALL = -1


@dataclass
class Layout:
    """What a task has to know to read a block."""

    bands: int
    means: np.ndarray
    mean_y: float
    block: int
    reach: int

    def dense(self, row: dict) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
        """(first index, stimulus less its means, response, weight) over the block and ``reach`` frames on either side, zeros where there is no frame."""
        first = row["block"] * self.block - self.reach
        size = self.block + 2 * self.reach
        x, y, w = np.zeros((size, self.bands)), np.zeros(size), np.zeros(size)
        at = np.asarray(row["t"]) - first
        x[at] = np.nan_to_num(np.asarray(row["x"], float).reshape(len(at), self.bands) - self.means)
        y[at], w[at] = row["y"], row["w"]
        return first, x, y, w


@dataclass
class Frames:
    """Blocks of frames in a written table: (p, block, n, t, x, y, w), n the set's length; arrays are one value a frame. ``names`` has (p, s, n): the number of each set."""

    blocks: DataFrame
    names: DataFrame
    sets: int
    layout: Layout


def frames(rows: DataFrame, set_col: str, index: str, x: str, y: str, w: str, bands: int, reach: int) -> Frames:
    """Deal frames into blocks; ``index`` counts from 0 in each set."""
    spark, block = rows.sparkSession, BLOCK
    own = rows.where(F.col(set_col).isNotNull() & (F.col(index) >= 0))
    own = own.select(F.col(set_col).alias("s"), F.col(index).cast("long").alias("t"), F.col(x).cast("array<double>").alias("x"), F.col(y).cast("double").alias("y"), F.col(w).cast("double").alias("w"))
    seen = F.coalesce((F.size("x") == bands) & F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v)), F.lit(False))
    answered = F.col("y").isNotNull() & ~F.isnan("y")
    own = own.select("s", "t", F.when(seen, F.col("x")).otherwise(F.array_repeat(F.lit(math.nan), bands)).alias("x"), F.when(answered, F.col("y")).otherwise(0.0).alias("y"), F.when(seen & answered & (F.col("w") > 0), F.col("w")).otherwise(0.0).alias("w"))
    near = F.sequence(F.greatest(F.lit(0), F.floor((F.col("t") - reach) / block)), F.floor((F.col("t") + reach) / block))
    spread = own.select("s", F.explode(near).alias("block"), F.struct("t", "x", "y", "w").alias("v"))
    packed = spread.groupBy("s", "block").agg(F.array_sort(F.collect_list("v")).alias("v"))
    # Of frames that share an index the first in order stays; a block past a set's end has no frame of its own.
    packed = packed.withColumn("v", F.filter("v", lambda v, i: (i == 0) | (F.get("v", i - 1)["t"] != v["t"])))
    packed = packed.where(F.exists("v", lambda v: F.floor(v["t"] / block) == F.col("block")))
    path = scratch_path(spark, "frames")
    packed.select("s", "block", F.col("v.t").alias("t"), F.flatten("v.x").alias("x"), F.col("v.y").alias("y"), F.col("v.w").alias("w")).write.parquet(path)
    kept = spark.read.parquet(path)
    names = cut(kept.groupBy("s").agg((F.max(F.array_max("t")) + 1).alias("n")).withColumn("p", F.monotonically_increasing_id()))
    sets = names.count()
    if sets < 3:
        raise ValueError("delete-one filters and their deviations need three sets")

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = np.zeros(bands + 2)  # a task's sums of w, w y and w x
        for batch in batches:
            for r in batch.to_pylist():
                w = np.where(np.array(r["t"]) // block == r["block"], r["w"], 0)
                v += np.concatenate(([w.sum(), w @ r["y"]], w @ np.nan_to_num(np.array(r["x"], float).reshape(len(w), bands))))
        yield _batch([(v,)], "v array<double>")

    sums = np.zeros(bands + 2)
    for r in kept.select("block", "t", "x", "y", "w").mapInArrow(part, "v array<double>").select(F.posexplode("v").alias("k", "v")).groupBy("k").agg(F.sum("v").alias("v")).collect():  # a row a band
        sums[r.k] = r.v
    means = sums[1:] / sums[0] if sums[0] else sums[1:]
    return Frames(kept.join(names, "s").drop("s"), names, sets, Layout(bands, means[1:], float(means[0]), block, reach))


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "array<double>": pa.list_(pa.float64())}
    names, types = zip(*(f.split(" ", 1) for f in schema.split(", ")), strict=True)
    return pa.RecordBatch.from_arrays([pa.array(list(v), kinds[k]) for v, k in zip(zip(*rows, strict=True), types, strict=True)], names=list(names))


def _added(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys..., value): arrays added up element by element."""
    flat = rows.select(*keys, F.posexplode(value).alias("k", "v")).groupBy(*keys, "k").agg(F.sum("v").alias("v"))
    return flat.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "v"))), lambda x: x["v"]).alias(value))


def products(f: Frames, lags: int) -> DataFrame:
    """(p, i, v) by set and band: sums of x_i(t - d) x_j(t) for d = 0..lags and all j, then of x_i(t - d) y(t) for d = -lags..lags.

    The row i = -1 has the weights that they are divided by. Stimuli count by the roots of both frames' weights, responses by their own.
    """

    at = f.layout

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        size = 8 * (at.bands + 1) * ((lags + 1) * at.bands + 2 * lags + 1)

        def out() -> Iterator[pa.RecordBatch]:
            for p, v in held.items():
                # The weights' row is as long as the lags alone.
                rows = [(p, i, v[i]) for i in range(at.bands)] + [(p, -1, np.concatenate((v[-1, : lags + 1], v[-1, lags + 1 : 3 * lags + 2])))]
                yield _batch(rows, "p long, i int, v array<double>")

        for batch in batches:
            for row in batch.to_pylist():
                first, x, y, w = at.dense(row)
                root = np.sqrt(w)
                xs, r = x * root[:, None], w * (y - at.mean_y)
                a, z = at.reach, at.reach + at.block
                v = held.get(row["p"])
                if v is None:
                    if held and (len(held) + 1) * size > HELD_BYTES:
                        yield from out()
                        held.clear()
                    v = held[row["p"]] = np.zeros((at.bands + 1, (lags + 1) * at.bands + 2 * lags + 1))
                there = np.zeros(len(w))  # frames of the set, of any weight
                there[max(0, -first) : max(0, min(len(w), row["n"] - first))] = 1
                for d in range(lags + 1):
                    v[:-1, d * at.bands : (d + 1) * at.bands] += xs[a - d : z - d].T @ xs[a:z]
                    v[-1, d] += root[a - d : z - d] @ root[a:z]
                for k, d in enumerate(range(-lags, lags + 1)):
                    v[:-1, (lags + 1) * at.bands + k] += x[a - d : z - d].T @ r[a:z]
                    v[-1, lags + 1 + k] += there[a - d : z - d] @ w[a:z]
        yield from out()

    return _added(f.blocks.mapInArrow(run, "p long, i int, v array<double>"), ["p", "i"], "v")


def _left_out(own: DataFrame) -> DataFrame:
    """Total less own for each set, and the total as the set ALL."""
    whole = cut(_added(own.drop("p"), ["i"], "v"))
    less = own.join(whole.withColumnRenamed("v", "whole"), "i").select("p", "i", F.zip_with("whole", "v", lambda a, b: a - b).alias("v"))
    return less.unionByName(whole.select(F.lit(ALL).alias("p"), "i", "v"))


def spectra(f: Frames, lags: int, noise: float) -> DataFrame:
    """(p, i, f, re, im, cross_re, cross_im): for each left-out set and band the spectrum of its products with all bands (those at lag 0 by half), and with the response.

    Above the frequency from which a band's products with the response stay under ``noise`` deviations of their delete-one values, in both parts, they fall
    off as a Gaussian; without such a frequency they do from 0 on.
    """
    nt, nf, bands, sets = 2 * lags + 1, lags + 1, f.layout.bands, f.sets
    left = cut(_left_out(cut(products(f, lags))))
    weights = left.where("i = -1").select("p", F.col("v").alias("weights"))
    mean = lambda v, n: F.when(n == 0, v).otherwise(v / n)
    auto = F.transform(F.slice("v", 1, nf * bands), lambda v, k: mean(v, F.get("weights", F.floor(k / bands).cast("int"))))
    cross = F.zip_with(F.slice("v", nf * bands + 1, nt), F.slice("weights", nf + 1, nt), mean)
    both = cut(left.where("i >= 0").join(weights, "p").select("p", "i", auto.alias("auto"), cross.alias("cross")))
    taper = np.hanning(nt)
    turn = np.exp(-2j * np.pi * np.outer(np.arange(nf), np.arange(nf)) / nt)  # (frequency, lag)

    def rolled(group: pa.Table) -> pa.Table:
        # One band's products with the response: a row a left-out set.
        order = np.argsort(group.column("p").to_numpy())  # the total is first
        p = group.column("p").to_numpy()[order]
        c = np.fft.fft(np.array(group.column("cross").to_pylist())[order] * taper, axis=1)[:, :nf]
        centre = c[1:].real.mean(0) + 1j * c[0].imag
        scale = noise * math.sqrt((sets - 1) ** 2 / sets)
        below = (abs(centre.real) < scale * c[1:].real.std(0, ddof=1)) & (abs(centre.imag) < scale * c[1:].imag.std(0, ddof=1))
        above = np.flatnonzero(~below)
        start = int(above[-1]) + 1 if below[-1] and len(above) else 0
        k = np.arange(nf)
        c[0] = centre
        c *= np.where(k > start, np.exp(-0.5 * ((k - start) / (nf - start)) ** 2), 1.0)
        return pa.table({"p": p, "i": pa.array([group.column("i")[0].as_py()] * len(p), pa.int32()), "cross_re": pa.array(list(c.real), pa.list_(pa.float64())), "cross_im": pa.array(list(c.imag), pa.list_(pa.float64()))})

    response = both.select("p", "i", "cross").groupBy("i").applyInArrow(rolled, "p long, i int, cross_re array<double>, cross_im array<double>")

    def turned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                v = np.array(r["auto"]).reshape(nf, bands) * taper[lags:, None]
                v[0] /= 2
                s = turn @ v
                yield _batch([(r["p"], r["i"], k, s[k].real, s[k].imag, r["cross_re"][k], r["cross_im"][k]) for k in range(nf)], SPECTRA)

    return both.drop("cross").join(response, ["p", "i"]).mapInArrow(turned, SPECTRA)


def _system(group: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The Hermitian matrix and right side of one (left-out set, frequency), from a row a band."""
    order = np.argsort(group.column("i").to_numpy())
    half = (np.array(group.column("re").to_pylist()) + 1j * np.array(group.column("im").to_pylist()))[order]
    return half + half.conj().T, (group.column("cross_re").to_numpy() + 1j * group.column("cross_im").to_numpy())[order]


SPECTRA = "p long, i int, f int, re array<double>, im array<double>, cross_re double, cross_im double"


def filters(f: Frames, lags: int, tolerances: list[float], noise: float = 0.5) -> DataFrame:
    """(p, i, tol, h, sd): for each left-out set (ALL: none), band and tolerance the filter over delays -lags..lags and its deviation over the other left-out sets.

    Systems get the tolerance times the largest Frobenius norm of the total's added to the size of their eigenvalues. The delays
    before 0 are damped by an arc tangent.
    """
    nt, nf, sets = 2 * lags + 1, lags + 1, f.sets
    rows = cut(spectra(f, lags, noise))

    def norm(group: pa.Table) -> pa.Table:
        return pa.table({"norm": [float(np.linalg.norm(_system(group)[0]))]})

    largest = rows.where(F.col("p") == ALL).groupBy("f").applyInArrow(norm, "norm double").agg(F.max("norm")).first()[0]
    penalties = np.array(tolerances) * largest

    def solve(group: pa.Table) -> pa.Table:
        a, c = _system(group)
        s, u = np.linalg.eigh(a)
        c = u.conj().T @ c
        h = u @ (np.where(s < 0, -1, 1) * c / (abs(s) + penalties[:, None])).T  # (band, tolerance)
        p, k, m = group.column("p")[0].as_py(), group.column("f")[0].as_py(), len(h)
        return pa.table({"p": pa.array([p] * m, pa.int64()), "i": pa.array(np.arange(m), pa.int32()), "f": pa.array([k] * m, pa.int32()), "re": pa.array(list(h.real), pa.list_(pa.float64())), "im": pa.array(list(h.imag), pa.list_(pa.float64()))})

    solved = rows.groupBy("p", "f").applyInArrow(solve, "p long, i int, f int, re array<double>, im array<double>")
    causal = _causal(lags)

    def back(group: pa.Table) -> pa.Table:
        # One band: all left-out sets and frequencies.
        i = group.column("i")[0].as_py()
        ps, at = np.unique(group.column("p").to_numpy(), return_inverse=True)
        full = np.zeros((len(ps), nt, len(tolerances)), complex)
        k = group.column("f").to_numpy()
        full[at, k] = np.array(group.column("re").to_pylist()) + 1j * np.array(group.column("im").to_pylist())
        full[:, nf:] = full[:, nf - 1 : 0 : -1].conj()
        return _described(i, ps, np.fft.ifft(full, axis=1).real.transpose(0, 2, 1) * causal, sets)

    return solved.groupBy("i").applyInArrow(back, FILTERS)


FILTERS = "p long, i int, tol int, h array<double>, sd array<double>"


def _causal(lags: int) -> np.ndarray:
    return (np.arctan(np.arange(-lags, lags + 1)) + np.pi / 2) / np.pi


def _described(i: int, ps: np.ndarray, h: np.ndarray, sets: int) -> pa.Table:
    """One band's filters, (left-out set, tolerance, delay), with their deviations over the other left-out sets; the total's is the mean of theirs."""
    one = ps != ALL
    # The variance over the others of each: sums about the mean of all less one's own.
    own = h[one] - h[one].mean(0)
    others = ((own**2).sum(0) - own**2) / (sets - 1) - (own / (sets - 1)) ** 2
    sd = np.zeros_like(h)
    sd[one] = np.sqrt(np.maximum(others, 0) * (sets - 2))
    sd[~one] = sd[one].mean(0)
    m = h.shape[1]
    n, nt = len(ps) * m, h.shape[2]
    return pa.table({"p": np.repeat(ps, m), "i": pa.array([i] * n, pa.int32()), "tol": pa.array(np.tile(np.arange(m), len(ps)), pa.int32()), "h": pa.array(list(h.reshape(n, nt)), pa.list_(pa.float64())), "sd": pa.array(list(sd.reshape(n, nt)), pa.list_(pa.float64()))})


def cut_inverse(c: np.ndarray, tol: float) -> np.ndarray:
    """Inverse of a symmetric matrix from its singular values: beyond those over ``tol`` times the largest, 1 / (tol times the largest) falling off as a Gaussian of their rank."""
    u, s, v = np.linalg.svd(c)
    least = tol * s[0] if len(s) else 0.0
    rank = int((s > least).sum())
    beyond = np.arange(len(s)) + 1 - rank
    scale = np.where(beyond > 0, np.exp(-(beyond**2) / 8) / (least or 1), 1 / np.where(beyond > 0, 1, s))
    return v.T @ np.diag(scale if s.any() else s) @ u.T


def separable_filters(f: Frames, lags: int, tolerances: list[float]) -> DataFrame:
    """(p, i, tol, h, sd) like ``filters`` for a stimulus whose correlation is one over bands times one over lags.

    The correlation of bands at no lag and that of all bands' courses over lags are made of all sets; a filter is the products with the response, times the
    inverse of the Toeplitz matrix of lags, then the inverse over bands, each with a rank cut. So a block costs its bands' square and its lags, not their
    product. The driver gets both matrices.
    """
    at, sets, nt = f.layout, f.sets, 2 * lags + 1
    if at.reach < 2 * lags:
        raise ValueError("blocks reach less far than lags")
    bands = at.bands

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for p, (v, n) in held.items():
                yield _batch([(p, i, v[i]) for i in range(bands)] + [(p, -1, n)], "p long, i int, v array<double>")

        for batch in batches:
            for row in batch.to_pylist():
                first, x, y, w = at.dense(row)
                root = np.sqrt(w)
                xs, r = x * root[:, None], w * (y - at.mean_y)
                a, z = at.reach, at.reach + at.block
                if row["p"] not in held:
                    if held and (len(held) + 1) * 8 * bands * (bands + nt) > HELD_BYTES:
                        yield from out()
                        held.clear()
                    held[row["p"]] = (np.zeros((bands, bands + nt)), np.zeros(2 * (2 * lags + 1) + nt))
                v, n = held[row["p"]]
                there = np.zeros(len(w))
                there[max(0, -first) : max(0, min(len(w), row["n"] - first))] = 1
                v[:, :bands] += xs[a:z].T @ xs[a:z]
                for d in range(2 * lags + 1):
                    n[d] += (xs[a - d : z - d] * xs[a:z]).sum()
                    n[2 * lags + 1 + d] += bands * (root[a - d : z - d] @ root[a:z])
                for k, d in enumerate(range(-lags, lags + 1)):
                    v[:, bands + k] += x[a - d : z - d].T @ r[a:z]
                    n[2 * (2 * lags + 1) + k] += there[a - d : z - d] @ w[a:z]
        yield from out()

    left = cut(_left_out(cut(_added(f.blocks.mapInArrow(run, "p long, i int, v array<double>"), ["p", "i"], "v"))))
    whole = {r.i: np.array(r.v) for r in left.where(F.col("p") == ALL).select("i", F.when(F.col("i") < 0, F.col("v")).otherwise(F.slice("v", 1, bands)).alias("v")).collect()}  # a row a band
    sums = whole.pop(-1)
    course = sums[: nt] / np.where(sums[nt : 2 * nt] == 0, 1, sums[nt : 2 * nt])
    weight = sums[nt] / bands
    space = np.array([whole[i] for i in range(bands)]) / (weight or 1)
    toeplitz = course[abs(np.subtract.outer(np.arange(nt), np.arange(nt)))]
    inverses = [(cut_inverse(space, t), cut_inverse(toeplitz, t)) for t in tolerances]
    counts = left.where("i = -1").select("p", F.slice("v", 2 * nt + 1, nt).alias("counts"))
    cross = left.where("i >= 0").join(counts, "p").select("p", "i", F.zip_with(F.slice("v", bands + 1, nt), "counts", lambda v, n: F.when(n == 0, v).otherwise(v / n)).alias("v"))

    def solve(group: pa.Table) -> pa.Table:
        # One left-out set: its products of all bands with the response.
        order = np.argsort(group.column("i").to_numpy())
        v = np.array(group.column("v").to_pylist())[order]
        h = np.array([s @ v @ t for s, t in inverses]).transpose(1, 0, 2)
        return pa.table({"p": group.column("p").take([0] * bands), "i": pa.array(np.arange(bands), pa.int32()), "h": pa.array(list(h.reshape(bands, -1)), pa.list_(pa.float64()))})

    causal, m = _causal(lags), len(tolerances)

    def describe(group: pa.Table) -> pa.Table:
        h = np.array(group.column("h").to_pylist()).reshape(-1, m, nt) * causal
        return _described(group.column("i")[0].as_py(), group.column("p").to_numpy(), h, sets)

    return cross.groupBy("p").applyInArrow(solve, "p long, i int, h array<double>").groupBy("i").applyInArrow(describe, FILTERS)


def shrunk(h: np.ndarray, sd: np.ndarray, n: float, eps: float = 1e-8) -> np.ndarray:
    """A filter scaled by a soft step at ``n`` deviations; n = 0 leaves it."""
    return h if n <= 0 else (1 + np.tanh(2 * (abs(h) - n * sd) / (eps + sd))) / 2 * h


@dataclass
class Fit:
    """``grid``: (tol, sparseness, r2cv, bits); ``filters``: (p, i, tol, h, sd) as above; ``best``: tolerance, sparseness and scores of the first grid point with the most bits."""

    grid: list[dict[str, float]]
    filters: DataFrame
    best: dict[str, float]


def reach_of(lags: int, smooth: int, rate: float, window: float) -> int:
    """How many frames beyond a block's ends ``fit`` needs."""
    return max(lags + round(rate * window), smooth // 2)


def fit(f: Frames, lags: int, delays: range, tolerances: list[float], sparsenesses: list[float], smooth: int = 31, rate: float = 1000.0, cutoff: float = 100.0, window: float = 0.5, nw: float = 3.0, noise: float = 0.5) -> Fit:
    """The grid of tolerances and sparsenesses scored on left-out sets: R2 of the rectified prediction against the response smoothed over ``smooth`` frames, and information.

    Information is the integral of -log2(1 - coherence) of prediction and response up to ``cutoff``, the coherence a jackknifed multitaper one over
    half-overlapping windows of ``window`` seconds, summed over sets by their lengths. Sets shorter than two windows or with no response count in neither.
    """
    at, sets, wide = f.layout, f.sets, round(rate * window)
    if at.reach < reach_of(lags, smooth, rate, window):
        raise ValueError("blocks reach less far than lags, smoothing and windows")
    done = cut(filters(f, lags, tolerances, noise))
    grid = [(k, n) for k in range(len(tolerances)) for n in sparsenesses]
    own = done.where(F.col("p") != ALL)
    kernels = own.groupBy("p").agg(F.array_sort(F.collect_list(F.struct("i", "tol", "h", "sd"))).alias("k"))
    kernels = kernels.select("p", F.flatten("k.h").alias("h"), F.flatten("k.sd").alias("sd"))
    heard = f.blocks.groupBy("p").agg(F.max(F.exists("y", lambda v: v != 0)).alias("heard"))
    kernels = kernels.join(heard, "p").where("heard").drop("heard")
    small = 16 * sets * at.bands * len(tolerances) * (2 * lags + 1) <= BROADCAST_BYTES
    if small:
        joined = f.blocks.join(F.broadcast(kernels), "p")
    else:  # a copy of the kernels for each block, so that a long set is many keys
        joined = f.blocks.join(f.blocks.select("p", "block").join(kernels, "p"), ["p", "block"])
    joined = joined.where(F.col("n") >= 2 * wide)
    shape = np.hanning(smooth)
    shape /= shape.sum()
    tapers = spectral.slepian_tapers(wide, nw, int(2 * nw - 1))
    step = wide // 2

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                first, x, y, w = at.dense(row)
                kept = np.array(row["h"]).reshape(at.bands, len(tolerances), 2 * lags + 1)
                sd = np.array(row["sd"]).reshape(kept.shape)
                use = slice(lags + delays.start, lags + delays.stop)
                h = np.array([shrunk(kept[:, k, use], sd[:, k, use], n) for k, n in grid])  # (grid, band, delay)
                a, z = at.reach, at.reach + at.block
                end = min(z + wide, row["n"] - first)  # predictions up to the last window's end, inside the set
                pred = np.full((len(grid), max(end - a, 0)), at.mean_y)
                for d in delays:
                    pred += h[:, :, d - delays.start] @ x[a - d : end - d].T if end > a else 0
                inside = slice(a, min(z, end))
                size = inside.stop - inside.start
                if size <= 0:
                    continue
                # np.convolve's centre of a window of an even length is its left one.
                half = (smooth - 1) // 2
                smoothed = np.convolve(y, shape)[half : half + len(y)][inside]
                ww = w[inside]
                rectified = np.maximum(pred[:, :size], 0)
                error = ((rectified - smoothed) ** 2) @ ww
                sums = (float(ww.sum()), float(ww @ smoothed), float(ww @ smoothed**2))
                rows = [(row["p"], g, -1, *sums, float(error[g]), None, None, None, None) for g in range(len(grid))]
                starts = [s for s in range(-(-(first + a) // step) * step, first + z, step) if s + wide <= row["n"]]
                if starts:
                    places = np.array(starts) - first - a
                    windows = lambda v: np.stack([v[..., s : s + wide] for s in places], -2)
                    fp = np.fft.rfft(tapers * windows(pred)[..., None, :], axis=-1)  # (grid, window, taper, f)
                    fy = np.fft.rfft(tapers * windows(y[a:])[..., None, :], axis=-1)
                    xy, xx, yy = (fp * fy.conj()).mean(-2), (abs(fp) ** 2).mean(-2), (abs(fy) ** 2).mean(-2)
                    for g in range(len(grid)):
                        rows += [(row["p"], g, s // step, None, None, None, None, xy[g, k].real, xy[g, k].imag, xx[g, k], yy[k]) for k, s in enumerate(starts)]
                yield _batch(rows, PREDICTED)

    scored = cut(joined.mapInArrow(predict, PREDICTED))
    sums = scored.where("win = -1").groupBy("g").agg(*(F.sum(c).alias(c) for c in ("w", "wy", "wyy", "error")))
    mean = F.col("wy") / F.col("w")
    r2 = sums.select("g", (1 - (F.col("error") / F.col("w")) / (F.col("wyy") / F.col("w") - mean * mean)).alias("r2cv"))
    coherent = spectral.jackknifed_coherence(scored.where("win >= 0"), ["p", "g"])
    hertz = F.col("f") * (rate / wide)
    bits = coherent.where((hertz < cutoff) & (hertz >= round(1 / window))).groupBy("p", "g").agg((-F.lit(rate / wide) * F.sum(F.log2(1 - F.col("coherence")))).alias("bits"))
    info = bits.join(f.names, "p").groupBy("g").agg((F.sum(F.col("bits") * F.col("n")) / F.sum("n")).alias("bits"))
    got = {r.g: r for r in r2.join(info, "g", "left").collect()}  # a row a grid point
    rows = [{"tol": tolerances[k], "sparseness": n, "r2cv": float(got[g].r2cv), "bits": float(got[g].bits or 0.0)} for g, (k, n) in enumerate(grid) if g in got]
    if not rows:
        raise ValueError("no set has a response over two windows")
    best = rows[0]
    for r in rows[1:]:
        if r["bits"] > best["bits"]:
            best = r
    return Fit(rows, done, best)


PREDICTED = "p long, g int, win long, w double, wy double, wyy double, error double, re array<double>, im array<double>, xx array<double>, yy array<double>"
