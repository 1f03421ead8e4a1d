"""Logistic, Poisson and linear responses by Newton's method, and searches on their error.

An iteration is one pass of sums, (features + 1)^2 of them or features + 1 a trial point; rows stay on the executors. Features are columns.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: For each family: the mean of a linear score, its derivative, and the error of a score.
FAMILIES: dict[str, tuple[Callable[[Column], Column], Callable[[Column], Column], Callable[[Column, Column], Column]]] = {
    "linear": (lambda s: s, lambda s: F.lit(1.0), lambda s, y: 0.5 * (s - y) * (s - y)),
    "logistic": (lambda s: 1 / (1 + F.exp(-s)), lambda s: 1 / (1 + F.exp(-s)) * (1 - 1 / (1 + F.exp(-s))), lambda s, y: F.log1p(F.exp(-F.abs(s))) + F.greatest(s, F.lit(0.0)) - y * s),
    "poisson": (F.exp, F.exp, lambda s, y: F.exp(s) - y * s),
}


def score(features: list[str], weights: np.ndarray) -> Column:
    """The linear score; the last weight is the bias."""
    out = F.lit(float(weights[-1]))
    for f, w in zip(features, weights[:-1], strict=True):
        out = out + F.lit(float(w)) * F.col(f)
    return out


def error_and_gradient(rows: DataFrame, features: list[str], y: str, family: str, weights: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean error, gradient and curvature at ``weights``: one pass."""
    mean, slope, error = FAMILIES[family]
    s = score(features, weights)
    names = [*(F.col(f).cast("double") for f in features), F.lit(1.0)]
    rest = mean(s) - F.col(y)
    sums = [F.avg(error(s, F.col(y))).alias("e"), *(F.avg(rest * x).alias(f"g{i}") for i, x in enumerate(names))]
    sums += [F.avg(slope(s) * names[i] * names[j]).alias(f"h{i}_{j}") for i in range(len(names)) for j in range(i, len(names))]
    r = rows.agg(*sums).first()
    n = len(names)
    g, h = np.array([r[f"g{i}"] or 0.0 for i in range(n)]), np.zeros((n, n))
    for i in range(n):
        for j in range(i, n):
            h[i, j] = h[j, i] = r[f"h{i}_{j}"] or 0.0
    return float(r.e or 0.0), g, h


def newton(rows: DataFrame, features: list[str], y: str, family: str, rounds: int = 15, penalty: float = 1e-9, stop: float = 1e-10) -> tuple[np.ndarray, list[float]]:
    """Weights with the bias last, and the error of each round. A step that makes the error worse is halved."""
    x = np.zeros(len(features) + 1)
    e, g, h = error_and_gradient(rows, features, y, family, x)
    errors = [e]
    for _ in range(rounds):
        step, size = np.linalg.solve(h + penalty * np.eye(len(x)), g), 1.0
        while True:
            new = x - size * step
            e2, g2, h2 = error_and_gradient(rows, features, y, family, new)
            if e2 <= e or size < 1e-3:
                break
            size /= 2
        if e - e2 < stop:
            break
        x, e, g, h = new, e2, g2, h2
        errors.append(e)
    return x, errors


def errors_and_gradients(rows: DataFrame, features: list[str], y: str, family: str, points: list[np.ndarray]) -> list[tuple[float, np.ndarray]]:
    """Mean error and gradient at each of several points: one pass for all of them. The points are a constant array, so every pass runs the same compiled code."""
    mean, _, error = FAMILIES[family]
    names = [*(F.col(f).cast("double") for f in features), F.lit(1.0)]
    spread = rows.select(*(x.alias(f"x{i}") for i, x in enumerate(names)), F.col(y).alias("y"), F.posexplode(F.lit([[float(w) for w in p] for p in points])).alias("k", "p"))
    s = sum((F.get("p", F.lit(i)) * F.col(f"x{i}") for i in range(1, len(names))), F.get("p", F.lit(0)) * F.col("x0"))
    sums = [F.avg(error(s, F.col("y"))).alias("e"), *(F.avg((mean(s) - F.col("y")) * F.col(f"x{i}")).alias(f"g{i}") for i in range(len(names)))]
    got = {r.k: (r.e, np.array([r[f"g{i}"] for i in range(len(names))], float)) for r in spread.groupBy("k").agg(*sums).collect()}  # a row a point
    nothing = (float("inf"), np.zeros(len(names)))
    return [(float("inf"), got[k][1]) if k in got and (got[k][0] is None or not np.isfinite(got[k][0])) else got.get(k, nothing) for k in range(len(points))]


def line_search_descent(rows: DataFrame, features: list[str], y: str, family: str, rounds: int = 20, stop: float = 1e-12) -> tuple[np.ndarray, list[float]]:
    """Gradient descent with the largest step, of twice the last one and its halves, that helps; all of a round's steps are tried in one pass."""
    x, step = np.zeros(len(features) + 1), 1.0
    ((e, g),) = errors_and_gradients(rows, features, y, family, [x])
    errors = [e]
    for _ in range(rounds):
        sizes = [step * 2.0**-k for k in range(20)]
        tried = errors_and_gradients(rows, features, y, family, [x - s * g for s in sizes])
        better = next((k for k, (e2, _) in enumerate(tried) if e2 < e), None)
        if better is None or e - tried[better][0] < stop:
            break
        x, step = x - sizes[better] * g, sizes[better] * 2
        e, g = tried[better]
        errors.append(e)
    return x, errors


#: Step sizes that a round tries, as shares of the one that the curvature foretells.
_LADDER = 1.5 ** np.arange(8, -12, -1.0)


def scaled_conjugate_gradient(rows: DataFrame, features: list[str], y: str, family: str, rounds: int = 200, stop: float = 1e-9) -> tuple[np.ndarray, list[float]]:
    """Conjugate gradients whose step follows from the curvature along the direction, found as a difference of gradients, and a scale that is
    raised where the error falls less than foretold and lowered where it falls as foretold.

    A round is one pass: the gradient a little ahead, for the curvature, and the error and gradient at a ladder of steps about the one that the last curvature foretells. Of
    these the best is taken; if none helps, the scale is raised and the next ladder starts from the curvature just found. Ends when the gradient is under ``stop``.
    """
    x = np.zeros(len(features) + 1)
    ((e, g),) = errors_and_gradients(rows, features, y, family, [x])
    errors, d, scale, bend, taken = [e], -g, 1.0, 0.0, 0
    for _ in range(rounds):
        if np.abs(g).max() < stop:
            break
        slope, size = float(d @ g), float(d @ d)
        if slope >= 0:
            d, slope, size = -g, -float(g @ g), float(g @ g)
        ahead = 1e-4 / np.sqrt(size)
        steps = _LADDER * (-slope / (max(bend, 0.0) * size + scale * size))
        tried = errors_and_gradients(rows, features, y, family, [x + ahead * d, *(x + s * d for s in steps)])
        bend = float(d @ (tried[0][1] - g)) / ahead / size
        best = min(range(len(steps)), key=lambda k: tried[k + 1][0])
        new, ahead_g = tried[best + 1]
        if not new < e:
            if -slope * steps[best] < 1e-16 * max(abs(e), 1.0):  # nothing left that a double can tell apart
                break
            scale *= 4
            continue
        ratio = 2 * (new - e) / (steps[best] * slope)
        scale = min(scale * 4, 1e100) if ratio < 0.25 else max(scale / 2, 1e-15) if ratio > 0.75 else scale
        x, taken = x + steps[best] * d, taken + 1
        d = -ahead_g if taken % len(x) == 0 else float((g - ahead_g) @ ahead_g) / slope * d - ahead_g
        e, g = new, ahead_g
        errors.append(e)
    return x, errors
