"""Regression on sparse event designs: a cell (set, t, feature, x) only where an event acts."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evokit.operators.regression import Moments, checked_sets


def sparse_moments(design: DataFrame, response: DataFrame, set_col: str, t: str, feature: str, x: str, y: str, w: str, features: int) -> dict[object, Moments]:
    """Weighted products by set from a sparse design and a dense response.

    Products of features are a self-join on (set, t), so a frame costs the square of the few features that act in it, not
    of all; sums combine before the shuffle. The driver gets features^2 numbers a set, and the number of sets is checked before it does.
    """
    checked_sets(response, set_col, features)
    frames = response.select(F.col(set_col).alias("s"), F.col(t).alias("t"), F.col(y).cast("double").alias("y"), F.col(w).cast("double").alias("w"))
    cells = design.select(F.col(set_col).alias("s"), F.col(t).alias("t"), F.col(feature).cast("int").alias("i"), F.col(x).cast("double").alias("x")).join(frames, ["s", "t"])
    ones = frames.groupBy("s").agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("y")).alias("wy"), F.sum(F.col("w") * F.col("y") * F.col("y")).alias("wyy"), F.count("*").alias("n")).collect()
    singles = cells.groupBy("s", "i").agg(F.sum(F.col("w") * F.col("x")).alias("wx"), F.sum(F.col("w") * F.col("x") * F.col("y")).alias("wxy")).collect()
    other = cells.select("s", "t", F.col("i").alias("j"), F.col("x").alias("z"))
    pairs = cells.join(other, ["s", "t"]).where("i <= j").groupBy("s", "i", "j").agg(F.sum(F.col("w") * F.col("x") * F.col("z")).alias("p")).collect()
    out = {}
    for r in sorted(ones, key=lambda r: str(r.s)):
        p = np.zeros((features + 2, features + 2))
        p[-2, -2], p[-1, -1] = r.w, r.wyy
        p[-2, -1] = p[-1, -2] = r.wy
        out[r.s] = Moments(p, r.n)
    for r in singles:
        p = out[r.s].products
        p[r.i, -2] = p[-2, r.i] = r.wx
        p[r.i, -1] = p[-1, r.i] = r.wxy
    for r in pairs:
        out[r.s].products[r.i, r.j] = out[r.s].products[r.j, r.i] = r.p
    return out
