"""Segmented models against dense fits that read the rows again."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from evokit.operators import designs, regression, segmented


def simulated(sets, features, seed):
    r = np.random.default_rng(seed)
    out = {}
    for s in range(sets):
        n = 40 + 9 * s
        x = (r.random((n, features)) < 0.3) * r.normal(1, 0.4, (n, features))
        x[:, -1] += 0.3 * x[:, 0]
        y = 0.4 + x @ np.linspace(1.2, -0.6, features) + 0.4 * r.normal(size=n)
        out[f"s{s}"] = (x, y, r.integers(1, 4, n).astype(float))
    return out


def dense(data, tolerances, invert, off, rectify, base=None):
    """(scores, best, weights, bias, kernels by set): every sum made from rows; ``base`` is what a stage before predicts, by set."""
    keys, kernels = sorted(data), {}
    left = {s: y - (base[s] if base else 0) for s, (_, y, _) in data.items()}
    total = sum(w.sum() for _, _, w in data.values())
    sx, sy = sum(w @ x for x, _, w in data.values()), sum(w @ left[s] for s, (_, _, w) in data.items())
    means, cxx, cxy = {}, {}, {}
    for s in keys:
        x, _, w = data[s]
        means[s] = ((sx - w @ x) / (total - w.sum()), (sy - w @ left[s]) / (total - w.sum()))
        d = x - means[s][0]
        cxx[s], cxy[s] = (d * w[:, None]).T @ d, d.T @ (w * (left[s] - means[s][1]))
    all_xx, all_xy = sum(cxx.values()), sum(cxy.values())
    less = {s: ((all_xx - cxx[s]) / (total - data[s][2].sum()), (all_xy - cxy[s]) / (total - data[s][2].sum())) for s in keys}
    norm = max(np.linalg.norm(c - np.diag(np.diag(c)) if off else c) for c, _ in less.values())
    y_all, w_all = np.concatenate([data[s][1] for s in keys]), np.concatenate([data[s][2] for s in keys])
    variance = np.average(y_all**2, weights=w_all) - np.average(y_all, weights=w_all) ** 2
    scores = []
    for t in tolerances:
        error = 0.0
        for s in keys:
            x, y, w = data[s]
            h = invert(less[s][0], t * norm) @ less[s][1]
            kernels.setdefault(s, []).append(h)
            pred = (x - means[s][0]) @ h + means[s][1] + (base[s] if base else 0)
            error += w @ ((np.maximum(pred, 0) if rectify else pred) - y) ** 2
        scores.append(1 - error / total / variance)
    best = int(np.argmax(scores))
    h = invert(all_xx / total, tolerances[best] * norm) @ (all_xy / total)
    return scores, best, h, sy / total - h @ sx / total, kernels


def as_tables(spark, data):
    cells = [(s, t, i, float(v), "c") for s, (x, _, _) in data.items() for t, row in enumerate(x) for i, v in enumerate(row) if v]
    frames = [(s, t, float(y[t]), float(w[t]), "c") for s, (_, y, w) in data.items() for t in range(len(y))]
    cells += [("s0", 9999, 0, 1.0, "c"), ("s0", 1, -1, 1.0, "c"), (None, 1, 0, 1.0, "c"), ("s0", 1, 0, None, "c")]
    frames += [(None, 1, 1.0, 1.0, "c"), ("s1", 800, None, 1.0, "c"), ("s1", 801, 3.0, 0.0, "c"), ("s1", 802, 3.0, None, "c")]
    cells += [(*cells[0][:3], 0.5, "c"), (*cells[0][:3], -0.5, "c")]
    return spark.createDataFrame(cells, "s string, t long, i int, x double, y string"), spark.createDataFrame(frames, "s string, t long, y double, w double, i string")


def ridge(c, t):
    return np.linalg.inv(c + t * np.eye(len(c)))


@pytest.mark.parametrize("kind,rectify", [("near", True), ("shrunk", True), ("ridge", True), ("ridge", False), ("near", False)])
def test_left_out_sets(spark, kind, rectify):
    data, tolerances = simulated(4, 4, 2), [0.5, 0.1, 0.01, 1e-4]
    p = segmented.products(*as_tables(spark, data), "s", "t", "i", "x", "y", "w", 4)
    got = segmented.fit(p, tolerances, kind, rectify)
    invert = {"near": regression.near_diagonal_inverse, "shrunk": regression.shrunk_diagonal_inverse, "ridge": ridge}[kind]
    scores, best, h, bias, kernels = dense(data, tolerances, invert, kind != "ridge", rectify)
    assert np.allclose(got.scores, scores) and got.best == best and np.allclose(got.weights, h) and np.isclose(got.bias, bias)
    for r in got.kernels.collect():
        assert np.allclose(np.array(r.h).reshape(4, 4), kernels[r.s])


def test_stages_from_one_pass(spark):
    """The second stage equals a fit to the rows' residuals."""
    data, tolerances = simulated(5, 7, 9), [0.3, 0.05, 0.005]
    first, second = segmented.fit_staged(segmented.products(*as_tables(spark, data), "s", "t", "i", "x", "y", "w", 7), 3, tolerances)
    one = dense({s: (x[:, :3], y, w) for s, (x, y, w) in data.items()}, tolerances, ridge, False, False)
    assert np.allclose(first.scores, one[0]) and first.best == one[1] and np.allclose(first.weights, one[2]) and np.isclose(first.bias, one[3])
    base = {s: x[:, :3] @ one[2] + one[3] for s, (x, _, _) in data.items()}
    two = dense({s: (x[:, 3:], y, w) for s, (x, y, w) in data.items()}, tolerances, ridge, False, False, base)
    assert np.allclose(second.scores, two[0]) and second.best == two[1] and np.allclose(second.weights, two[2]) and np.isclose(second.bias, two[3])
    assert max(second.scores) > max(first.scores)


def test_near_diagonal_inverse():
    r = np.random.default_rng(3)
    for n in (1, 2, 5, 12):
        a = r.normal(size=(n, 2 * n))
        c = a @ a.T / n
        assert np.allclose(regression.near_diagonal_inverse(c, 0.0), np.linalg.inv(c))
        assert np.allclose(regression.near_diagonal_inverse(c, 1e15), np.diag(1 / np.diag(c)), atol=1e-9)
        half = regression.near_diagonal_inverse(c, 0.5)
        assert np.isfinite(half).all()
    # A zero on the diagonal, and a zero denominator (a singular matrix), are defined.
    c = np.array([[2.0, 0.0, 0.5], [0.0, 0.0, 0.0], [0.5, 0.0, 1.0]])
    out = regression.near_diagonal_inverse(c, 0.0)
    assert np.allclose(out[np.ix_([0, 2], [0, 2])], np.linalg.inv(c[np.ix_([0, 2], [0, 2])])) and not out[1].any() and not out[:, 1].any()
    assert np.isfinite(regression.near_diagonal_inverse(np.ones((3, 3)), 0.0)).all()


def test_defined(spark):
    cells, frames = as_tables(spark, simulated(3, 3, 4))
    p = segmented.products(cells, frames, "s", "t", "i", "x", "y", "w", 5)  # two features never act
    got = segmented.fit(p, [0.1], "near")
    assert not got.weights[3:].any() and got.weights[:3].all()
    for few in (frames.where("s = 's0'"), frames.where("false")):
        with pytest.raises(ValueError, match="two"):
            segmented.fit(segmented.products(cells, few, "s", "t", "i", "x", "y", "w", 3), [0.1])
    with pytest.raises(ValueError, match="rectified"):
        segmented.fit(p, [0.1], "ridge", True, np.eye(7)[2:])


def test_sets_are_counted_first(spark, monkeypatch):
    rows = spark.range(40).select((F.col("id") % 20).alias("s"), F.col("id").alias("t"), F.rand(1).alias("x"), F.rand(2).alias("y"), F.lit(1.0).alias("w"), F.array(F.rand(3), F.rand(4)).alias("v"))
    monkeypatch.setattr(regression, "MAX_NUMBERS", 19 * 9)
    monkeypatch.setattr(type(rows), "collect", lambda self: pytest.fail("collected before the sets were counted"))
    for run in (lambda: regression.moments(rows, ["x"], "y", "w", "s"), lambda: designs.sparse_moments(rows.withColumn("i", F.lit(0)), rows, "s", "t", "i", "x", "y", "w", 1)):
        with pytest.raises(ValueError, match="over 19 sets"):
            run()
