import math

import numpy as np
from pyspark.sql import functions as F

from evokit import catalog
from evokit.operators import glm, kernels, regression, spectral
from evokit.operators import statistics as st


def test_newton_recovers_weights(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(1500, 2))
    rows = [(*map(float, a), float(r.poisson(math.exp(0.3 * a[0] - 0.5 * a[1] + 0.2)))) for a in x]
    df = spark.createDataFrame(rows, "a double, b double, y double").persist()
    w, errors = glm.newton(df, ["a", "b"], "y", "poisson")
    assert np.allclose(w, [0.3, -0.5, 0.2], atol=0.12) and all(p >= q for p, q in zip(errors, errors[1:], strict=False))
    assert np.abs(glm.error_and_gradient(df, ["a", "b"], "y", "poisson", w)[1]).max() < 1e-4
    lin, _ = glm.newton(df, ["a", "b"], "y", "linear")
    assert np.allclose(lin, np.linalg.lstsq(np.column_stack((x, np.ones(1500))), np.array([q[2] for q in rows]), rcond=None)[0], atol=1e-6)
    _, slow = glm.line_search_descent(df, ["a", "b"], "y", "poisson", 4)
    assert slow[-1] < slow[0] and errors[-1] <= slow[-1] + 1e-9


def test_kernel_fits(spark):
    t = np.arange(30.0)
    a, b = kernels.laguerre_curve(t, 2.0, 3.0, 2.0), kernels.gaussian_pair(t, np.array([2, 5, 2, 1, 12, 3, 0.1]))
    rows = [(k, int(i), float(v)) for k, y in enumerate((a, b)) for i, v in enumerate(y)]
    df = spark.createDataFrame(rows, "k int, lag int, v double")
    lg = kernels.fitted(df.where("k = 0"), "k", "lag", "v", kernels.fit_laguerre, ["amp", "tau", "alpha"]).first()
    assert np.allclose([lg.amp, lg.tau, lg.alpha], [2.0, 3.0, 2.0], atol=1e-3)
    dg = kernels.fitted(df.where("k = 1"), "k", "lag", "v", kernels.fit_gaussians, list("abcdefg")).first()
    assert np.allclose(kernels.gaussian_pair(t, np.array(dg[1:])), b, atol=1e-3)
    two = kernels.laguerre_curve(t, 1.0, 3.0, 2.0, 2)
    x = t / 3
    assert np.allclose(two, np.exp(-x) * x**2 * (x**2 / 2 - 4 * x + 6))


def test_priors(spark):
    rows = {(x.i, x.j): x.v for x in kernels.smoothness_prior(spark, (2, 3, 2)).collect()}
    full = np.zeros((12, 12))
    for (i, j), v in rows.items():
        full[i, j] = v
    assert np.array_equal(full, kernels.laplacian((2, 3, 2))) and np.allclose(full.sum(1), 0)
    r = np.random.default_rng(2)
    x = r.normal(size=(80, 6))
    z = np.column_stack((x, np.ones(80), x[:, 0] + 0.1 * r.normal(size=80)))
    m = regression.Moments(z.T @ z, 80)
    path = kernels.prior_path(m, m, kernels.laplacian((6,)), first=64.0, last=0.5)
    assert [p[0] for p in path] == [64.0, 32.0, 16.0, 8.0, 4.0, 2.0, 1.0] and path[-1][1] < path[0][1]


def test_features(spark):
    v = np.random.default_rng(3).normal(size=64)
    df = spark.createDataFrame([(1, [float(x) for x in v])], "k int, v array<float>")
    got = kernels.gabor_energy(df, "v", 8, 2, (1.0,)).first()
    a, b = ((kernels.gabor(8, 0.0, 1.0, p).ravel() @ v) for p in (0.0, math.pi / 2))
    assert math.isclose(got.g_0_0, math.hypot(a, b), rel_tol=1e-5)
    power = kernels.modulation_power(df, "k", "v", 8).first().power
    assert np.allclose(power, (abs(np.fft.fft2(v.astype(np.float32).astype(float).reshape(8, 8))) ** 2).ravel(), rtol=1e-5)


def test_poisson_rate(spark):
    t = kernels.poisson_times(spark.range(40).withColumnRenamed("id", "u"), "u", 20.0, 30.0, lambda t: F.lit(10.0), 3)
    assert abs(t.count() - 40 * 300) < 6 * math.sqrt(40 * 300)
    assert t.agg(F.max("t")).first()[0] < 30


def test_poisson_times_stay_in_their_rows(spark):
    """All tasks share the units of one partition, nothing is shuffled or sorted but the units, and times are running sums of their gaps."""
    units = spark.range(60).coalesce(1).withColumnRenamed("id", "u")
    got = kernels.poisson_times(units, "u", 100.0, 200.0, lambda t: 50 + 40 * F.sin(t), 3)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Window" not in plan and "Sort" not in plan
    assert got.select(F.spark_partition_id()).distinct().count() > 1
    n = math.ceil(20_000 + 6 * math.sqrt(20_000))
    draw = lambda i, salt: (F.pmod(F.xxhash64("u", i, F.lit(3), F.lit(salt)), F.lit(1 << 53)) + 0.5) / float(1 << 53)
    rows = units.where("u in (0, 31, 59)").select("u", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i"))
    for u in (0, 31, 59):
        own = rows.where(F.col("u") == u).select("i", (-F.log(draw(F.col("i") + 1, 1)) / 100.0).alias("gap"), (draw(F.col("i"), 2) * 100.0).alias("cut")).orderBy("i").toPandas()
        t = own["gap"].to_numpy().cumsum()
        want = t[(t < 200) & (own["cut"].to_numpy() < 50 + 40 * np.sin(t))]
        assert np.array_equal(np.sort([x.t for x in got.where(F.col("u") == u).collect()]), want), u


def test_noise_and_ragged(spark):
    df = spark.createDataFrame([(1, 2.0), (1, 4.0), (2, 5.0)], "k int, v double")
    got = sorted((x.k, x.v, x.noise_own, x.noise_others) for x in st.trial_noise(df, ["k"], "v").collect())
    assert got == [(1, 2.0, -1.0, -2.0), (1, 4.0, 1.0, 2.0), (2, 5.0, 0.0, None)]
    arrays = spark.createDataFrame([(1, [1.0, 2.0]), (1, [3.0])], "k int, v array<double>")
    assert sorted((x.i, x.mean, x.n) for x in st.ragged_average(arrays, "k", "v").collect()) == [(0, 2.0, 2), (1, 2.0, 1)]


def test_bandpass_and_welch(spark):
    t = np.arange(512)
    y = np.sin(2 * np.pi * t / 8) + np.sin(2 * np.pi * t / 64)
    df = spark.createDataFrame([(1, int(i), float(v)) for i, v in enumerate(y)], "k int, t int, v double")
    out = spectral.bandpass(df, "k", "t", "v", 0.1, 0.2, 1.0).orderBy("i").toPandas()["value"]
    assert np.allclose(out, np.sin(2 * np.pi * t / 8), atol=1e-6)
    p = spectral.welch(df, "k", "t", "v", 128).orderBy("f").toPandas()["power"].to_numpy()
    assert int(np.argmax(p[4:])) + 4 == 16
    assert math.isclose(spectral.coherence_full(1.0, 4), 1.0)


def test_sparse_design_is_dense_design(spark):
    from evokit.operators import designs

    r = np.random.default_rng(8)
    x = r.normal(size=(60, 4)) * (r.random((60, 4)) < 0.3)
    y, w, s = r.normal(size=60), r.uniform(0.5, 2, 60), np.arange(60) // 20
    cells = [(int(s[t]), t, j, float(x[t, j])) for t in range(60) for j in range(4) if x[t, j]]
    frames = [(int(s[t]), t, float(y[t]), float(w[t])) for t in range(60)]
    by = designs.sparse_moments(spark.createDataFrame(cells, "s int, t int, j int, x double"), spark.createDataFrame(frames, "s int, t int, y double, w double"), "s", "t", "j", "x", "y", "w", 4)
    for k in range(3):
        z = np.column_stack((x, np.ones(60), y))[s == k]
        assert np.allclose(by[k].products, (z * w[s == k][:, None]).T @ z) and by[k].rows == 20


def test_grid_components_and_folds(spark):
    r = np.random.default_rng(21)
    x = r.normal(size=(300, 4)) @ np.diag([3, 1, 0.3, 0.1]) + 1
    y = x @ [1.0, 0.0, -0.5, 0.0] + 2 + r.normal(size=300)
    rows = spark.createDataFrame([(i % 6, v.tolist(), float(b)) for i, (v, b) in enumerate(zip(x, y, strict=True))], "s int, v array<double>, y double")
    by = regression.array_moments(rows, "v", "y", "s")
    sets = np.arange(300) % 6
    fits = {}
    norm = max(np.linalg.norm(np.cov(x[sets != s].T, bias=True)) for s in range(6))
    for tol in (0.1, 0.001):
        hs = []
        for s in range(6):
            a, b = x[sets != s], y[sets != s]
            c = np.cov(a.T, bias=True) + tol * norm * np.eye(4)
            hs.append(np.linalg.solve(c, (a - a.mean(0)).T @ (b - b.mean()) / len(b)))
        sd = np.array(hs).std(0) * 5**0.5
        for n in (0, 2):
            error = 0.0
            for s, h in enumerate(hs):
                h = h * (1 + np.tanh(2 * (abs(h) - n * sd) / (sd + 1e-12))) / 2 if n else h
                error += ((x[sets == s] @ h + y[sets != s].mean() - x[sets != s].mean(0) @ h - y[sets == s]) ** 2).sum()
            fits[tol, n] = 1 - error / 300 / y.var()
    got, best = regression.direct_fit_grid(by, [0.1, 0.001], [0, 2])
    assert all(abs(g["r2cv"] - fits[g["tol"], g["sparseness"]]) < 1e-9 for g in got) and len(got) == 4
    assert best["r2cv"] == max(g["r2cv"] for g in got)

    u, s, vt = np.linalg.svd(x - x.mean(0), full_matrices=False)
    for k in (1, 2, 4):
        coef, bias = regression.component_regression(regression.total(by), k)
        want = vt[:k].T @ (u[:, :k].T @ (y - y.mean()) / s[:k])
        assert np.allclose(coef, want) and abs(bias - (y.mean() - x.mean(0) @ want)) < 1e-9

    scores, best, coef, _ = regression.penalty_by_folds(by, [0.01, 1.0, 1e4])
    for g in scores:
        rs = []
        for f in range(3):
            test = sets % 3 == f
            a, b = x[~test], y[~test]
            h = np.linalg.solve(np.cov(a.T, bias=True) + g["penalty"] * np.eye(4), (a - a.mean(0)).T @ (b - b.mean()) / len(b))
            rs.append(np.corrcoef(x[test] @ h, y[test])[0, 1])
        assert abs(g["r"] - np.mean(rs)) < 1e-9
    assert best == max(scores, key=lambda g: g["r"])["penalty"] and len(coef) == 4


def test_moments_of_partitions_without_rows(spark):
    """A split of a file may be without rows; rows that are not whole take no part."""
    r = np.random.default_rng(5)
    whole = [(i % 3, r.normal(size=4).tolist(), float(i % 2)) for i in range(30)]
    odd = [(0, None, 1.0), (1, [1.0, None, 2.0, 3.0], 0.0), (2, [1.0, math.nan, 2.0, 3.0], 1.0), (None, [1.0] * 4, 0.0), (0, [1.0] * 4, None), (1, [math.inf] * 4, 1.0)]
    for rows in (whole, whole + odd):
        df = spark.createDataFrame(rows, "s int, v array<double>, y double").repartition(2)
        by = regression.array_moments(df.unionByName(df.where("s > 5").repartition(3)), "v", "y", "s")
        assert list(by) == [0, 1, 2]
        for k, m in by.items():
            z = np.array([[*v, 1, y] for s, v, y in whole if s == k])
            assert m.rows == 10 and np.allclose(m.products, z.T @ z)


def test_array_moments_queries_on_split_files(spark, tmp_path):
    """Embeddings in one row group that is read as several splits, all but one of them without rows."""
    spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    names = ("component_regression", "conjugate_gradient_fit", "group_ridge_fit", "lars_path", "lasso_first_knot", "lasso_path", "path_following", "pca_top", "ridge_vectors_loo")
    want = {n: sorted(map(tuple, catalog.queries()[n](spark, "/root/testdata/sf0.01").collect())) for n in names}
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40000")
    try:
        assert spark.read.parquet(str(tmp_path / "embeddings.parquet")).rdd.getNumPartitions() > 2
        for n in names:
            assert sorted(map(tuple, catalog.queries()[n](spark, str(tmp_path)).collect())) == want[n], n
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
