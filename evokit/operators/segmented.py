"""Segmented models: kernels at events fitted with every set left out in turn, and stages fitted to what a stage before leaves.

One pass over the rows makes the weighted products of all features, of 1 and of the response, by set; they stay rows of a
table. What follows is sums of them: a left-out set's covariances are about the weighted means of the *other* sets, a residual's products are a
linear map of the products, and errors of unrectified predictions are quadratic forms in them, so a second stage reads no row again. Each set's
matrix is put together, mapped and solved in a group of its own, of (features + 2)^2 numbers; the driver gets features + 2 sums, the largest norm and
one score a tolerance.

Defined results: cells without a frame, and frames without a set or index, take no part; a null response or weight, or a weight of 0 or less, takes its frame out; a null value
of a cell is 0; cells that repeat a (frame, feature) are added up; a feature that never acts has the coefficient 0; a set without frames does not exist; fewer
than two sets raise an error, an empty table too.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evokit.operators.direct_fit import _added
from evokit.operators.regression import near_diagonal_inverse, shrunk_diagonal_inverse
from evokit.session import cut

TOLERANCES = (0.2, 0.1, 0.05, 0.01, 0.005, 0.001, 0.0005, 0.0001, 0.00001, 0.0)


@dataclass
class Products:
    """``rows``: (s, i, j, p) for i <= j, sums of w v_i v_j by set; v is the features, then 1, then the response. Products that are 0 may be left out."""

    rows: DataFrame
    features: int
    cells: DataFrame
    frames: DataFrame


def products(design: DataFrame, response: DataFrame, set_col: str, t: str, feature: str, x: str, y: str, w: str, features: int) -> Products:
    """From a sparse design, a row (set, frame, feature, value) where an event acts, and the response of each frame. Products of features are
    a self-join on the frame, so a frame costs the square of the few features that act in it, and sums combine before the shuffle."""
    frames = response.select(F.col(set_col).alias("s"), F.col(t).alias("t"), F.col(y).cast("double").alias("y"), F.col(w).cast("double").alias("w"))
    frames = cut(frames.where("s is not null and t is not null and y is not null and not isnan(y) and w > 0"))
    cells = design.select(F.col(set_col).alias("s"), F.col(t).alias("t"), F.col(feature).cast("int").alias("i"), F.coalesce(F.col(x).cast("double"), F.lit(0.0)).alias("x"))
    cells = cut(cells.where((F.col("i") >= 0) & (F.col("i") < features)).groupBy("s", "t", "i").agg(F.sum("x").alias("x")).join(frames, ["s", "t"]))
    other = cells.select("s", "t", F.col("i").alias("j"), F.col("x").alias("z"))
    w, one, y = F.col("w"), F.lit(features), F.lit(features + 1)
    pairs = cells.join(other, ["s", "t"]).where("i <= j").groupBy("s", "i", "j").agg(F.sum(w * F.col("x") * F.col("z")).alias("p"))
    singles = cells.groupBy("s", "i").agg(F.sum(w * F.col("x")).alias("a"), F.sum(w * F.col("x") * F.col("y")).alias("b"))
    singles = singles.select("s", "i", F.explode(F.array(F.struct(one.alias("j"), F.col("a").alias("p")), F.struct(y.alias("j"), F.col("b").alias("p")))).alias("v")).select("s", "i", "v.j", "v.p")
    sums = frames.groupBy("s").agg(F.sum("w").alias("a"), F.sum(w * F.col("y")).alias("b"), F.sum(w * F.col("y") * F.col("y")).alias("c"))
    sums = sums.select("s", F.explode(F.array(*(F.struct(i.alias("i"), j.alias("j"), F.col(c).alias("p")) for i, j, c in ((one, one, "a"), (one, y, "b"), (y, y, "c"))))).alias("v")).select("s", "v.*")
    return Products(cut(pairs.unionByName(singles).unionByName(sums)), features, cells, frames)


def _matrix(group: pa.Table, size: int) -> np.ndarray:
    out = np.zeros((size, size))
    i, j, p = (group.column(c).to_numpy() for c in ("i", "j", "p"))
    out[i, j] = out[j, i] = p
    return out


def _ridge(c: np.ndarray, tol: float) -> np.ndarray:
    u, s, v = np.linalg.svd(c)
    return v.T @ np.diag(np.where(s + tol > 0, 1 / np.where(s + tol > 0, s + tol, 1), 0)) @ u.T


#: How covariances are inverted at a tolerance, and whether its scale is the norm of what is off their diagonal.
INVERSES: dict[str, tuple[Callable[[np.ndarray, float], np.ndarray], bool]] = {"near": (near_diagonal_inverse, True), "shrunk": (shrunk_diagonal_inverse, True), "ridge": (_ridge, False)}


@dataclass
class Fit:
    """``scores``: R2 of left-out sets by tolerance; ``weights`` and ``bias`` of all sets at the best; ``kernels``: (s, bias, h) of each left-out set, arrays over tolerances."""

    scores: list[float]
    best: int
    weights: np.ndarray
    bias: float
    kernels: DataFrame


def fit(p: Products, tolerances: list[float], inverse: str = "near", rectify: bool = True, lift: np.ndarray | None = None) -> Fit:
    """Fit with each set left out, score the predictions of it, and fit all sets at the first best tolerance.

    ``lift`` maps (features, 1, response) of the products to those that are fitted: (fewer or other features, 1, residual), a row each. R2 is
    that of the whole response. Rectified predictions are made row by row and only without ``lift``; others are scored by the products alone.
    """
    size = p.features + 2
    lift = np.eye(size) if lift is None else lift
    if rectify and len(lift) != size:
        raise ValueError("predictions of a later stage are not rectified")
    n, (invert, off) = len(lift) - 2, INVERSES[inverse]
    kind = p.rows.schema["s"].dataType.simpleString()
    sums = np.zeros((size, size))
    for r in p.rows.where((F.col("i") >= p.features) | (F.col("j") >= p.features)).groupBy("i", "j").agg(F.sum("p").alias("p")).collect():  # 2 features + 3 rows
        sums[r.i, r.j] = sums[r.j, r.i] = r.p
    sets = p.frames.select("s").distinct().count()
    if sets < 2:
        raise ValueError("a set can only be left out of two or more")
    # Only the lift of the column of ones is needed of the total.
    first = lift @ sums[:, -2]
    weight = first[-2]

    def centred(group: pa.Table) -> pa.Table:
        """A set's products about the means of the others: a row a feature, the last entry its product with the response."""
        m = lift @ _matrix(group, size) @ lift.T
        rest = weight - m[-2, -2]
        means = (first - m[:, -2]) / rest if rest > 0 else np.zeros(n + 2)
        a = m - np.outer(means, m[-2]) - np.outer(m[:, -2], means) + m[-2, -2] * np.outer(means, means)
        return pa.table({"s": group.column("s").take([0] * n), "i": pa.array(np.arange(n), pa.int32()), "n": [float(m[-2, -2])] * n, "mean": means[:n], "mean_y": [float(means[-1])] * n, "v": pa.array(list(np.delete(a[:n], -2, 1)), pa.list_(pa.float64()))})

    own = cut(p.rows.groupBy("s").applyInArrow(centred, f"s {kind}, i int, n double, mean double, mean_y double, v array<double>"))
    whole = cut(_added(own, ["i"], "v"))
    less = own.join(whole.withColumnRenamed("v", "all"), "i").select("s", "i", "n", "mean", "mean_y", F.zip_with("all", "v", lambda a, b: (a - b) / (F.lit(weight) - F.col("n"))).alias("v"))
    less = cut(less.where(F.col("n") < weight))
    square = F.aggregate(F.transform(F.slice("v", 1, n), lambda x, k: F.when(F.lit(off) & (k == F.col("i")), 0.0).otherwise(x * x)), F.lit(0.0), lambda a, b: a + b)
    largest = less.groupBy("s").agg(F.sum(square).alias("q")).agg(F.max("q")).first()[0] or 0.0
    penalties = [t * largest**0.5 for t in tolerances]

    def matrix_of(group: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.argsort(group.column("i").to_numpy())
        v = np.array(group.column("v").to_pylist()).reshape(-1, n + 1)[order]
        return v[:, :n], v[:, n], order

    def solve(group: pa.Table) -> pa.Table:
        c, b, order = matrix_of(group)
        h = np.array([invert(c, t) @ b for t in penalties]).reshape(-1, n)
        bias = group.column("mean_y")[0].as_py() - h @ group.column("mean").to_numpy()[order]
        return pa.table({"s": group.column("s")[:1], "bias": pa.array([bias], pa.list_(pa.float64())), "h": pa.array([h.ravel()], pa.list_(pa.float64()))})

    kernels = cut(less.groupBy("s").applyInArrow(solve, f"s {kind}, bias array<double>, h array<double>"))
    k = len(tolerances)
    if rectify:
        scored = _rectified_errors(p, kernels, k)
    else:

        def errors(left: pa.Table, right: pa.Table) -> pa.Table:
            if not right.num_rows or not left.num_rows:
                return pa.table({"e": pa.array([], pa.list_(pa.float64()))})
            m = lift @ _matrix(left, size) @ lift.T
            h, bias = np.array(right.column("h")[0].as_py()).reshape(k, n), np.array(right.column("bias")[0].as_py())
            c = np.column_stack((h, bias, -np.ones(k)))
            return pa.table({"e": pa.array([np.einsum("ki,ij,kj->k", c, m, c)], pa.list_(pa.float64()))})

        each = p.rows.groupBy("s").cogroup(kernels.groupBy("s")).applyInArrow(errors, "e array<double>")
        scored = each.agg(*(F.sum(F.get("e", F.lit(q))).alias(f"e{q}") for q in range(k)))
    error = np.array(list(scored.first()), float)
    variance = sums[-1, -1] / sums[-2, -2] - (sums[-1, -2] / sums[-2, -2]) ** 2
    r2 = 1 - error / sums[-2, -2] / variance
    best = int(np.argmax(r2))

    def finish(group: pa.Table) -> pa.Table:
        c, b, _ = matrix_of(group)
        return pa.table({"h": pa.array([invert(c / weight, penalties[best]) @ (b / weight)], pa.list_(pa.float64()))})

    h = np.array(whole.withColumn("one", F.lit(0)).groupBy("one").applyInArrow(finish, "h array<double>").first().h)
    # The residual's total: only its sum with the ones is needed.
    return Fit([float(v) for v in r2], best, h, float(first[-1] / weight - h @ first[:n] / weight), kernels)


def _rectified_errors(p: Products, kernels: DataFrame, k: int) -> DataFrame:
    """One row of weighted squared errors of max(prediction, 0), a column a tolerance: each set predicted by the kernels that were fitted without it."""
    n = p.features
    by_feature = kernels.select("s", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i"), "h").select("s", "i", F.array(*(F.get("h", F.col("i") + q * n) for q in range(k))).alias("h"))
    summed = p.cells.select("s", "t", "i", "x").join(by_feature, ["s", "i"]).groupBy("s", "t").agg(*(F.sum(F.col("x") * F.get("h", F.lit(q))).alias(f"p{q}") for q in range(k)))
    rows = p.frames.join(kernels.select("s", "bias"), "s").join(summed, ["s", "t"], "left")
    pred = lambda q: F.greatest(F.coalesce(F.col(f"p{q}"), F.lit(0.0)) + F.get("bias", F.lit(q)), F.lit(0.0))
    return rows.agg(*(F.sum(F.col("w") * (pred(q) - F.col("y")) * (pred(q) - F.col("y"))).alias(f"e{q}") for q in range(k)))


def fit_staged(p: Products, first: int, tolerances: list[float], inverse: str = "ridge") -> tuple[Fit, Fit]:
    """The first ``first`` features fitted to the response, then the others to what is left of it, from the same products."""
    size, rest = p.features + 2, p.features - first
    one = np.zeros((first + 2, size))
    one[range(first), range(first)] = one[-2, -2] = one[-1, -1] = 1
    stage = fit(p, tolerances, inverse, False, one)
    two = np.zeros((rest + 2, size))
    two[range(rest), range(first, p.features)] = two[-2, -2] = two[-1, -1] = 1
    two[-1, :first], two[-1, -2] = -stage.weights, -stage.bias
    return stage, fit(p, tolerances, inverse, False, two)
