"""Linear and generalised models from sufficient statistics.

Sums of weighted products are made once a set by Spark and combine before the shuffle; delete-one statistics are
total less own. What reaches the driver is those sums: (features + 2)^2 numbers a set, so its size does not depend on
the rows; the number of sets is checked. Dense solves of that size are numpy.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_SETS = 10_000
#: Numbers of all sets' products that the driver takes.
MAX_NUMBERS = 50_000_000


def most_sets(features: int) -> int:
    """How many sets the driver takes the products of."""
    return min(MAX_SETS, MAX_NUMBERS // (features + 2) ** 2)


def checked_sets(rows: DataFrame, set_col: str | Column, features: int) -> None:
    """Raises an error before anything is collected if there are more sets than the driver takes."""
    most = most_sets(features)
    if rows.select(set_col).distinct().limit(most + 1).count() > most:
        raise ValueError(f"over {most} sets of {features} features")


@dataclass
class Moments:
    """Weighted products of (features, 1, y) of one set."""

    products: np.ndarray
    rows: int

    def __add__(self, other: Moments) -> Moments:
        return Moments(self.products + other.products, self.rows + other.rows)

    def __sub__(self, other: Moments) -> Moments:
        return Moments(self.products - other.products, self.rows - other.rows)

    @property
    def weight(self) -> float:
        return self.products[-2, -2]

    def centred(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """Covariances of the features, with y, the features' means and y's mean."""
        p, w = self.products, self.weight
        mx, my = p[:-2, -2] / w, p[-1, -2] / w
        return p[:-2, :-2] / w - np.outer(mx, mx), p[:-2, -1] / w - mx * my, mx, my

    def squared_error(self, coef: np.ndarray, bias: float) -> float:
        """Weighted sum of (prediction - y)^2 of this set, from the products alone."""
        c = np.concatenate((coef, [bias, -1.0]))
        return float(c @ self.products @ c)


def moments(rows: DataFrame, features: list[str], y: str, w: str | Column, set_col: str | None = None) -> dict[object, Moments]:
    """Products by set (one set, None, without a set column)."""
    names = [*(F.col(f) for f in features), F.lit(1.0), F.col(y)]
    weight = F.col(w) if isinstance(w, str) else w
    sums = [F.sum(weight * names[i] * names[j]).alias(f"p{i}_{j}") for i in range(len(names)) for j in range(i, len(names))]
    keys = [F.col(set_col).alias("s")] if set_col else [F.lit(None).cast("string").alias("s")]
    if set_col:
        checked_sets(rows, set_col, len(features))
    got = rows.groupBy(*keys).agg(*sums, F.count("*").alias("n")).collect()
    out = {}
    for r in sorted(got, key=lambda r: str(r.s)):
        p = np.zeros((len(names), len(names)))
        for i in range(len(names)):
            for j in range(i, len(names)):
                p[i, j] = p[j, i] = r[f"p{i}_{j}"] or 0.0
        out[r.s] = Moments(p, r.n)
    return out


def array_moments(rows: DataFrame, vector: str, y: str, set_col: str) -> dict[object, Moments]:
    """Like ``moments`` with unit weights for a column of arrays: one partial product matrix a partition and set.

    Rows without a set, a response or a vector, or with a null or non-finite component, take no part.
    """
    import pandas as pd

    kind = rows.schema[set_col].dataType.simpleString()
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    rows = rows.where(F.col(set_col).isNotNull() & finite(F.col(y)) & F.forall(vector, finite))

    def part(batches):
        sums: dict[object, tuple[np.ndarray, int]] = {}
        for pdf in batches:
            for s, g in pdf.groupby("s"):
                x = np.column_stack((np.stack(g["v"].to_numpy()).astype(float), np.ones(len(g)), g["y"].to_numpy(float)))
                p, n = sums.get(s, (0.0, 0))
                sums[s] = (p + x.T @ x, n + len(x))
        if sums:  # an empty frame has no type for its lists, and a split of a file may be without rows
            yield pd.DataFrame({"s": list(sums), "p": [p.ravel() for p, _ in sums.values()], "n": [n for _, n in sums.values()]})

    parts = rows.select(F.col(set_col).alias("s"), F.col(vector).alias("v"), F.col(y).alias("y")).mapInPandas(part, f"s {kind}, p array<double>, n long")

    def join(g: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"s": [g["s"].iloc[0]], "p": [np.sum(np.stack(g["p"].to_numpy()), axis=0)], "n": [int(g["n"].sum())]})

    width = rows.agg(F.max(F.size(vector))).first()[0] or 0
    checked_sets(rows, set_col, width)
    whole = parts.groupBy("s").applyInPandas(join, f"s {kind}, p array<double>, n long").collect()
    side = lambda p: int(round(len(p) ** 0.5))
    return {r.s: Moments(np.array(r.p).reshape(side(r.p), -1), r.n) for r in sorted(whole, key=lambda r: str(r.s))}


def total(by_set: dict[object, Moments]) -> Moments:
    return sum(list(by_set.values())[1:], next(iter(by_set.values())))


def ridge(m: Moments, penalty: float) -> tuple[np.ndarray, float]:
    """Coefficients and bias with ``penalty`` added to every eigenvalue of the features' covariance."""
    c, b, mx, my = m.centred()
    s, u = np.linalg.eigh(c)
    coef = u @ ((u.T @ b) / (s + penalty)) if len(b) else b
    return coef, float(my - mx @ coef)


def ridge_loo(by_set: dict[object, Moments], tolerances: list[float]) -> list[dict[str, float]]:
    """For each tolerance, the pooled R2 of each set predicted by the others; penalties are tolerance * largest norm."""
    whole = total(by_set)
    norm = max(np.linalg.norm((whole - m).centred()[0]) for m in by_set.values())
    p, w = whole.products, whole.weight
    variance = p[-1, -1] / w - (p[-1, -2] / w) ** 2
    out = []
    for tol in tolerances:
        error = sum(m.squared_error(*ridge(whole - m, tol * norm)) for m in by_set.values())
        out.append({"tol": tol, "r2cv": 1 - error / w / variance})
    return out


def shrunk(h: np.ndarray, sd: np.ndarray, n: float, eps: float = 1e-12) -> np.ndarray:
    """Coefficients scaled by a soft step at ``n`` standard deviations; n = 0 leaves them."""
    return h if n <= 0 else (1 + np.tanh(2 * (abs(h) - n * sd) / (sd + eps))) / 2 * h


def direct_fit_grid(by_set: dict[object, Moments], tolerances: list[float], sparsenesses: list[float]) -> tuple[list[dict[str, float]], dict[str, float]]:
    """R2 of each set predicted by the others for each tolerance and sparseness, and the first best of them.

    The delete-one fits of a tolerance are shrunk where they are under ``sparseness`` of their jackknife deviations;
    their biases follow from the means of the sets that they were fitted to.
    """
    whole = total(by_set)
    norm = max(np.linalg.norm((whole - m).centred()[0]) for m in by_set.values())
    p, w = whole.products, whole.weight
    variance = p[-1, -1] / w - (p[-1, -2] / w) ** 2
    out: list[dict[str, float]] = []
    for tol in tolerances:
        fits = np.array([ridge(whole - m, tol * norm)[0] for m in by_set.values()])
        sd = fits.std(axis=0) * np.sqrt(len(fits) - 1)
        for n in sparsenesses:
            error = 0.0
            for m, h in zip(by_set.values(), shrunk(fits, sd, n), strict=True):
                _, _, mx, my = (whole - m).centred()
                error += m.squared_error(h, float(my - mx @ h))
            out.append({"tol": tol, "sparseness": n, "r2cv": float(1 - error / w / variance)})
    best = out[0]
    for r in out[1:]:
        if r["r2cv"] > best["r2cv"]:
            best = r
    return out, best


def penalty_by_folds(by_set: dict[object, Moments], penalties: list[float], folds: int = 3) -> tuple[list[dict[str, float]], float, np.ndarray, float]:
    """(scores, penalty, coefficients, bias): sets dealt out to folds in their order, the mean correlation of the folds' predictions for each penalty, and the refit with the first best."""
    groups = [total(dict(enumerate(g))) for g in (list(by_set.values())[k::folds] for k in range(folds)) if g]
    whole = total(dict(enumerate(groups)))

    def correlation(m: Moments, h: np.ndarray) -> float:
        c, b, _, _ = m.centred()
        p, w = m.products, m.weight
        scale = (h @ c @ h) * (p[-1, -1] / w - (p[-1, -2] / w) ** 2)
        return float(h @ b / np.sqrt(scale)) if scale > 0 else 0.0

    scores = [{"penalty": v, "r": float(np.mean([correlation(m, ridge(whole - m, v)[0]) for m in groups]))} for v in penalties]
    best = max(scores, key=lambda s: s["r"])["penalty"]
    return scores, best, *ridge(whole, best)


def shrunk_diagonal_inverse(c: np.ndarray, tol: float) -> np.ndarray:
    """Inverse that shrinks off-diagonal parts: (c + tol diag c)^-1 (1 + tol)."""
    return np.linalg.inv(c / (1 + tol) + np.diag(np.diag(c)) * tol / (1 + tol))


def near_diagonal_inverse(c: np.ndarray, tol: float) -> np.ndarray:
    """Inverse of a symmetric matrix as its diagonal's, updated by one singular pair of the rest at a time, each damped by s / (s + tol).

    With tol 0 it is the inverse, with a large one that of the diagonal. An update whose denominator is 0, to rounding, is left out; an entry of the diagonal
    that is 0 has the inverse 0, and its row and column take no part.
    """
    d = np.diag(c).copy()
    used = np.flatnonzero(d)
    out, own = np.zeros_like(c, dtype=float), c[np.ix_(used, used)]
    inverse = np.diag(1 / d[used])
    u, s, v = np.linalg.svd(own - np.diag(d[used]))
    for k in np.flatnonzero(s > 0):
        left, right = inverse @ (s[k] * u[:, k]), v[k] @ inverse
        denominator = 1 + s[k] * (right @ u[:, k])
        if abs(denominator) > 1e-12:
            inverse = inverse - s[k] / (s[k] + tol) * np.outer(left, right) / denominator
    out[np.ix_(used, used)] = inverse
    return out


def gradient_descent(m: Moments, step: float, rounds: int, momentum: float = 0.0, coordinate: bool = False) -> list[np.ndarray]:
    """The path of coefficients on the mean squared error of centred data; optionally one coordinate a round, by its sign."""
    c, b, _, _ = m.centred()
    h, v, path = np.zeros(len(b)), np.zeros(len(b)), []
    for _ in range(rounds):
        g = c @ h - b
        if coordinate:
            k = int(np.argmax(abs(g)))
            d = np.zeros(len(b))
            d[k] = np.sign(g[k])
        else:
            d = g
        v = momentum * v - step * d
        h = h + v
        path.append(h)
    return path


def conjugate_gradient(m: Moments, rounds: int, penalty: float = 0.0) -> np.ndarray:
    c, b, _, _ = m.centred()
    a = c + penalty * np.eye(len(b))
    h, r = np.zeros(len(b)), b.copy()
    d = r.copy()
    for _ in range(rounds):
        if r @ r < 1e-30:
            break
        alpha = (r @ r) / (d @ a @ d)
        h, new = h + alpha * d, r - alpha * (a @ d)
        d, r = new + (new @ new) / (r @ r) * d, new
    return h


def lars(m: Moments, steps: int) -> list[tuple[int, np.ndarray]]:
    """Least-angle path on standardised features: (variables in, coefficients) a step."""
    c, b, _, _ = m.centred()
    scale = np.sqrt(np.diag(c))
    c, b = c / np.outer(scale, scale), b / scale
    h, active, out = np.zeros(len(b)), [], []
    for _ in range(min(steps, len(b))):
        r = b - c @ h
        rest = [j for j in range(len(b)) if j not in active]
        active.append(max(rest, key=lambda j: abs(r[j])))
        top = abs(r[active[-1]])
        sign = np.sign(r[active])
        g = np.linalg.solve(c[np.ix_(active, active)], sign)
        a = c[:, active] @ g
        gamma = top
        for j in range(len(b)):
            if j not in active:
                for q in ((top - r[j]) / (1 - a[j] or np.inf), (top + r[j]) / (1 + a[j] or np.inf)):
                    if 1e-12 < q < gamma:
                        gamma = q
        h = h.copy()
        h[active] += gamma * g
        out.append((len(active), h / scale))
    return out


class Factor:
    """The upper triangular R with R'R the matrix of the variables that are in; variables come in at the end and go out anywhere."""

    def __init__(self, c: np.ndarray):
        self.c, self.r, self.active = c, np.zeros((0, 0)), []

    def insert(self, j: int) -> bool:
        """False, and nothing done, if the variable depends on those that are in."""
        col = np.linalg.solve(self.r.T, self.c[self.active, j]) if self.active else np.zeros(0)
        rest = self.c[j, j] - col @ col
        if rest <= 1e-12 * max(self.c[j, j], 1e-300):
            return False
        n = len(self.active)
        r = np.zeros((n + 1, n + 1))
        r[:n, :n], r[:n, n], r[n, n] = self.r, col, np.sqrt(rest)
        self.r = r
        self.active.append(j)
        return True

    def delete(self, j: int) -> None:
        k = self.active.index(j)
        r = np.delete(self.r, k, 1)
        for i in range(k, r.shape[1]):  # rotations bring it back to a triangle
            a, b = r[i, i], r[i + 1, i]
            size = np.hypot(a, b)
            turn = np.array([[a, b], [-b, a]]) / size if size else np.eye(2)
            r[i : i + 2, i:] = turn @ r[i : i + 2, i:]
        self.r = r[:-1]
        self.active.pop(k)

    def solve(self, b: np.ndarray) -> np.ndarray:
        return np.linalg.solve(self.r, np.linalg.solve(self.r.T, b))


@dataclass
class Knot:
    """Where a variable comes in or goes out: the penalty, the coefficients on standardised features, the variables in, and the estimated risk with them."""

    penalty: float
    coef: np.ndarray
    active: list[int]
    risk: float


def lasso_path(m: Moments, ridge: float = 0.0, most: int | None = None, max_l1: float = 0.0) -> tuple[list[Knot], np.ndarray]:
    """(knots, scale): minimisers of |y - X h|^2 / 2n + penalty |h|_1 + ridge |h|^2 / 2 from the largest penalty down, on features of mean 0 and deviation 1.

    A variable goes out when its coefficient comes to 0. With ``ridge`` over 0 it is an elastic net. The path ends without penalty, after ``most`` knots, or
    where the coefficients' sizes add up to ``max_l1`` (0: no bound). The risk is error / variance - rows + 2 (variables + 1), of which the least is a place to stop.
    Features that do not vary, or depend on those that are in, stay out. ``h / scale`` are coefficients of the features themselves.
    """
    c, b, _, my = m.centred()
    sd = np.sqrt(np.maximum(np.diag(c), 0))
    used = sd > 1e-12 * max(sd.max(initial=0), 1e-300)
    scale = np.where(used, sd, 1.0)
    c, b = c / np.outer(scale, scale) + ridge * np.eye(len(b)), np.where(used, b / scale, 0)
    yy = m.products[-1, -1] / m.weight - my**2
    h, factor, knots = np.zeros(len(b)), Factor(c), []
    shut = set(np.flatnonzero(~used).tolist())
    penalty = float(np.abs(b).max(initial=0))

    def note() -> None:
        error = m.weight * (yy - 2 * h @ b + h @ (c - ridge * np.eye(len(b))) @ h)
        knots.append(Knot(penalty, h.copy(), sorted(factor.active), float(error / yy - m.weight + 2 * (len(factor.active) + 1)) if yy > 0 else 0.0))

    note()
    coming: int | None = int(np.argmax(np.abs(b))) if penalty > 0 else None
    while penalty > 0 and (most is None or len(knots) < most):
        if coming is not None and not factor.insert(coming):
            shut.add(coming)
        r = b - c @ h
        if not factor.active:
            break
        g = factor.solve(np.sign(r[factor.active]))
        a = c[:, factor.active] @ g
        step, coming, going = penalty, None, None
        for j in range(len(b)):
            if j in factor.active or j in shut:
                continue
            for q in ((penalty - r[j]) / (1 - a[j]) if a[j] != 1 else np.inf, (penalty + r[j]) / (1 + a[j]) if a[j] != -1 else np.inf):
                if 1e-12 * penalty < q < step:
                    step, coming, going = q, j, None
        for j, v in zip(factor.active, g, strict=True):
            q = -h[j] / v if v else np.inf
            if 1e-12 * penalty < q < step:
                step, coming, going = q, None, j
        if max_l1:
            own = h[factor.active]
            grown = float(np.where(own != 0, np.sign(own), np.sign(g)) @ g)
            room = (max_l1 - np.abs(h).sum()) / grown if grown > 0 else np.inf
            if room <= step:
                h[factor.active] += room * g
                penalty -= room
                note()
                break
        h[factor.active] += step * g
        penalty = max(penalty - step, 0.0)
        if going is not None:
            h[going] = 0.0
            factor.delete(going)
        note()
        if coming is None and going is None:
            break
    return knots, scale


def principal_components(m: Moments, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Largest variances and their directions; the largest entry of a direction is positive."""
    s, u = np.linalg.eigh(m.centred()[0])
    s, u = s[::-1][:k], u[:, ::-1][:, :k]
    return s, u * np.sign(u[np.argmax(abs(u), axis=0), np.arange(u.shape[1])])


def component_regression(m: Moments, k: int) -> tuple[np.ndarray, float]:
    """Coefficients and bias of a regression on the ``k`` largest principal components of the features; directions without variance are left out."""
    _, b, mx, my = m.centred()
    s, u = principal_components(m, k)
    keep = s > 1e-12 * max(s[0], 1e-300) if len(s) else np.zeros(0, bool)
    coef = u[:, keep] @ ((u[:, keep].T @ b) / s[keep])
    return coef, float(my - mx @ coef)


def group_ridge(m: Moments, groups: list[list[int]], draws: int, penalty: float, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Banded ridge: the best of hashed-seed random scalings of the groups' blocks, by generalised cross-validation."""
    rng = np.random.default_rng(seed)
    c, b, _, _ = m.centred()
    yy = m.products[-1, -1] / m.weight - (m.products[-1, -2] / m.weight) ** 2
    best = None
    for _ in range(draws):
        gamma = rng.dirichlet(np.ones(len(groups)))
        scale = np.ones(len(b))
        for g, v in zip(groups, gamma, strict=True):
            scale[g] = np.sqrt(v)
        cs, bs = c * np.outer(scale, scale), b * scale
        inv = np.linalg.inv(cs + penalty * np.eye(len(b)))
        h = inv @ bs
        dof = np.trace(inv @ cs)
        score = (yy - 2 * h @ bs + h @ cs @ h) / (1 - dof / m.rows) ** 2
        if best is None or score < best[0]:
            best = (score, h * scale, gamma)
    return best[1], best[2]
