"""Paths and searches against the conditions that their minima meet."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from evokit.operators import glm, regression


def moments_of(x, y):
    v = np.column_stack((x, np.ones(len(x)), y))
    return regression.Moments(v.T @ v, len(x))


@pytest.mark.parametrize("ridge", [0.0, 0.3])
def test_lasso_conditions_at_every_knot(ridge):
    drops = 0
    for seed in range(12):
        r = np.random.default_rng(seed)
        n, k = 60, 8
        x = r.normal(size=(n, k)) @ r.normal(size=(k, k))
        y = x @ r.normal(size=k) + 3 * r.normal(size=n)
        m = moments_of(x, y)
        knots, scale = regression.lasso_path(m, ridge)
        z, yc = (x - x.mean(0)) / x.std(0), y - y.mean()
        assert np.allclose(scale, x.std(0))
        for knot in knots:
            grad = z.T @ (yc - z @ knot.coef) / n - ridge * knot.coef
            assert np.all(np.abs(grad) <= knot.penalty + 1e-9)
            on = knot.coef != 0
            assert np.allclose(grad[on], knot.penalty * np.sign(knot.coef[on])) and set(np.flatnonzero(on)) <= set(knot.active)
            assert np.isclose(knot.risk, ((yc - z @ knot.coef) ** 2).sum() / yc.var() - n + 2 * (len(knot.active) + 1))
        drops += sum(len(b.active) < len(a.active) for a, b in zip(knots, knots[1:], strict=False))
        assert knots[0].penalty > knots[-1].penalty == 0 and all(a.penalty >= b.penalty for a, b in zip(knots, knots[1:], strict=False))
        assert np.allclose(knots[-1].coef, np.linalg.solve(z.T @ z / n + ridge * np.eye(k), z.T @ yc / n))
        half = np.abs(knots[-1].coef).sum() / 2
        assert np.isclose(np.abs(regression.lasso_path(m, ridge, max_l1=half)[0][-1].coef).sum(), half)
        assert len(regression.lasso_path(m, ridge, most=3)[0]) == 3
    assert drops > 0 or ridge


def test_lasso_of_odd_features():
    r = np.random.default_rng(1)
    x = r.normal(size=(40, 3))
    x = np.column_stack((x, np.full(40, 2.0), x[:, 0]))  # one that does not vary, and a copy
    knots, _ = regression.lasso_path(moments_of(x, x[:, 0] - x[:, 1] + 0.1 * r.normal(size=40)))
    assert all(k.coef[3] == 0 for k in knots) and len({0, 4} & set(knots[-1].active)) == 1
    knots, _ = regression.lasso_path(moments_of(x, np.ones(40)))
    assert len(knots) == 1 and not knots[0].coef.any()


def test_factor_takes_variables_in_and_out():
    r = np.random.default_rng(2)
    a = r.normal(size=(20, 6))
    c = a.T @ a
    f = regression.Factor(c)
    for j in (3, 0, 5, 1):
        assert f.insert(j)
    f.delete(0)
    f.delete(1)
    assert f.insert(4) and f.active == [3, 5, 4]
    assert np.allclose(f.r.T @ f.r, c[np.ix_(f.active, f.active)]) and np.allclose(f.r, np.triu(f.r))
    assert np.allclose(f.solve(np.ones(3)), np.linalg.solve(c[np.ix_(f.active, f.active)], np.ones(3)))


@pytest.mark.parametrize("family", ["logistic", "poisson", "linear"])
def test_searches_end_at_newtons_minimum(spark, monkeypatch, family):
    r = np.random.default_rng(4)
    x = r.normal(size=(400, 2)) * [1.0, 3.0]
    s = 0.3 + x @ [0.6, -0.2]
    y = {"logistic": (r.random(400) < 1 / (1 + np.exp(-s))).astype(float), "poisson": r.poisson(np.exp(s)).astype(float), "linear": s + r.normal(size=400)}[family]
    rows = spark.createDataFrame([(float(a), float(b), float(c)) for (a, b), c in zip(x, y, strict=True)], "a double, b double, y double").coalesce(1).persist()
    w, errors = glm.newton(rows, ["a", "b"], "y", family)
    passes = []
    plain = glm.errors_and_gradients
    monkeypatch.setattr(glm, "errors_and_gradients", lambda *args: passes.append(1) or plain(*args))
    jobs = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup(f"scg-{family}", "counted")
    got, own = glm.scaled_conjugate_gradient(rows, ["a", "b"], "y", family)
    assert np.allclose(got, w, atol=1e-5) and own[-1] - errors[-1] < 1e-9 and all(b < a for a, b in zip(own, own[1:], strict=False))
    assert len(own) <= len(passes) < 80
    ran = len(jobs.getJobIdsForGroup(f"scg-{family}"))
    passes.clear()
    spark.sparkContext.setJobGroup("none", "others")
    assert ran <= 2 * len(own) + 20  # adaptive execution may run a job for the stage before
    got, own = glm.line_search_descent(rows, ["a", "b"], "y", family, 40)
    assert own[-1] - errors[-1] < 1e-4 and len(passes) <= len(own) + 1
    rows.unpersist()


def test_points_in_one_pass(spark):
    rows = spark.createDataFrame([(1.0, 2.0), (2.0, 0.0), (-1.0, 1.0)], "a double, y double")
    points = [np.array([0.1, 0.2]), np.array([-0.4, 1.0]), np.array([900.0, 900.0])]
    for p, (e, g) in zip(points[:2], glm.errors_and_gradients(rows, ["a"], "y", "poisson", points), strict=False):
        e2, g2, _ = glm.error_and_gradient(rows, ["a"], "y", "poisson", p)
        assert np.isclose(e, e2) and np.allclose(g, g2)
    assert glm.errors_and_gradients(rows, ["a"], "y", "poisson", points)[2][0] == np.inf
    assert rows.select(F.col("a")).count() == 3
