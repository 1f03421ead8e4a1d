"""The direct fit against a dense numpy fit of whole sets."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from evokit.operators import direct_fit, spectral


def simulated(sets, bands, seed):
    """{set: (x, y, w)} with a filter over two delays and noise; the last set has no response."""
    r = np.random.default_rng(seed)
    out = {}
    for s in range(sets):
        n = 230 + 37 * s
        x = r.normal(size=(n, bands))
        x[:, 1:] += 0.5 * x[:, :-1]
        y = 1.5 + x @ np.linspace(1, -0.5, bands) + np.concatenate(([0], x[:-1] @ np.linspace(-0.3, 0.8, bands))) + 0.5 * r.normal(size=n)
        out[s] = (x, y, r.integers(0, 4, n).astype(float))
    return out


def dense_products(x, y, w, lags):
    n = len(y)
    root, at = np.sqrt(w), np.arange(n)
    auto = np.zeros((2 * lags + 1, x.shape[1], x.shape[1]))
    cross, n_auto, n_cross = np.zeros((x.shape[1], 2 * lags + 1)), np.zeros(2 * lags + 1), np.zeros(2 * lags + 1)
    for k, d in enumerate(range(-lags, lags + 1)):
        t = at[(at - d >= 0) & (at - d < n)]
        auto[k] = (x[t - d] * root[t - d, None]).T @ (x[t] * root[t, None])
        n_auto[k] = root[t - d] @ root[t]
        cross[:, k] = x[t - d].T @ (w * y)[t]
        n_cross[k] = w[t].sum()
    return auto, cross, n_auto, n_cross


def dense_fit(data, lags, tolerances, noise=0.5):
    """{left-out set or None: (tolerance, band, delay)}, deviations likewise, means."""
    keys = sorted(data)
    total = sum(w.sum() for _, _, w in data.values())
    mx, my = sum(w @ x for x, _, w in data.values()) / total, sum(w @ y for _, y, w in data.values()) / total
    own = {s: dense_products(x - mx, y - my, w, lags) for s, (x, y, w) in data.items()}
    nt, nf, bands = 2 * lags + 1, lags + 1, len(mx)
    taper = np.hanning(nt)
    auto, cross = {}, {}
    for p in [None, *keys]:
        a, c, na, nc = (sum(own[s][j] for s in keys if s != p) for j in range(4))
        a, c = a / np.where(na == 0, 1, na)[:, None, None], c / np.where(nc == 0, 1, nc)
        auto[p] = np.fft.fft(np.fft.ifftshift(a * taper[:, None, None], axes=0), axis=0)
        cross[p] = np.fft.fft(c * taper, axis=1)
    deleted = np.array([cross[p] for p in keys])
    centre = deleted.real.mean(0) + 1j * cross[None].imag
    k = len(keys)
    scale = np.sqrt((k - 1) ** 2 / k)
    for b in range(bands):
        start = 0
        for f in range(nf):
            if abs(centre[b, f].real) < noise * scale * deleted[:, b, f].real.std(ddof=1) and abs(centre[b, f].imag) < noise * scale * deleted[:, b, f].imag.std(ddof=1):
                start = start or f
            else:
                start = 0
        cross[None][b] = centre[b]
        for f in range(start + 1, nf):
            for p in cross:
                cross[p][b, f] *= np.exp(-0.5 * ((f - start) / (nf - start)) ** 2)
    norm = max(np.linalg.norm(auto[None][f]) for f in range(nf))
    h = {p: np.zeros((len(tolerances), bands, nt)) for p in cross}
    for p in h:
        for q, tol in enumerate(tolerances):
            full = np.zeros((bands, nt), complex)
            for f in range(nf):
                u, s, v = np.linalg.svd(auto[p][f])
                full[:, f] = v.conj().T @ ((u.conj().T @ cross[p][:, f]) / (s + tol * norm))
                if f:
                    full[:, nt - f] = full[:, f].conj()
            h[p][q] = np.fft.ifft(full, axis=1).real * (np.arctan(np.arange(-lags, lags + 1)) + np.pi / 2) / np.pi
    sd = {p: np.std([h[q] for q in keys if q != p], axis=0) * np.sqrt(k - 2) for p in keys}
    sd[None] = np.mean([sd[p] for p in keys], axis=0)
    return h, sd, mx, my


def dense_coherence(a, b, window, nw=3.0):
    tapers = spectral.slepian_tapers(window, nw, 5)
    xy, xx, yy = [], [], []
    for s in range(0, len(a) - window + 1, window // 2):
        fa, fb = (np.fft.rfft(tapers * v[s : s + window], axis=1) for v in (a, b))
        xy.append((fa * fb.conj()).mean(0))
        xx.append((abs(fa) ** 2).mean(0))
        yy.append((abs(fb) ** 2).mean(0))
    xy, xx, yy = map(np.array, (xy, xx, yy))
    z = lambda xy, xx, yy: np.arctanh(np.minimum(abs(xy) / np.sqrt(xx * yy), 1 - 1e-12))
    n = len(xy)
    pseudo = n * z(xy.sum(0), xx.sum(0), yy.sum(0)) - (n - 1) * z(xy.sum(0) - xy, xx.sum(0) - xx, yy.sum(0) - yy)
    return np.tanh(np.maximum(pseudo.mean(0), 0)) ** 2


def as_rows(spark, data):
    rows = [(f"s{s}", t, [float(v) for v in x[t]], float(y[t]), float(w[t]), "c") for s, (x, y, w) in data.items() for t in range(len(y))]
    return spark.createDataFrame(rows, "s string, t long, x array<double>, y double, w double, block string")


@pytest.mark.parametrize("bands,lags", [(3, 5), (1, 3)])
def test_filters_and_grid(spark, monkeypatch, bands, lags):
    monkeypatch.setattr(direct_fit, "BLOCK", 64)
    data = simulated(4, bands, 3)
    tolerances, sparsenesses, smooth, rate, window = [0.1, 0.01], [0.0, 1.0], 5, 100.0, 0.32
    h, sd, mx, my = dense_fit(data, lags, tolerances)
    f = direct_fit.frames(as_rows(spark, data), "s", "t", "x", "y", "w", bands, direct_fit.reach_of(lags, smooth, rate, window))
    assert np.allclose(f.layout.means, mx) and np.isclose(f.layout.mean_y, my)
    got = direct_fit.fit(f, lags, range(0, lags), tolerances, sparsenesses, smooth, rate, 40.0, window)
    number = {r.p: int(r.s[1:]) for r in f.names.collect()} | {direct_fit.ALL: None}
    rows = got.filters.collect()
    assert len(rows) == 5 * bands * 2
    for r in rows:
        assert np.allclose(r.h, h[number[r.p]][r.tol, r.i], atol=1e-9) and np.allclose(r.sd, sd[number[r.p]][r.tol, r.i], atol=1e-9)
    shape, wide = np.hanning(smooth) / np.hanning(smooth).sum(), 32
    for g in got.grid:
        q = tolerances.index(g["tol"])
        err = sw = swy = swyy = bits = length = 0.0
        for s, (x, y, w) in data.items():
            k = direct_fit.shrunk(h[s][q], sd[s][q], g["sparseness"])
            pred = np.full(len(y), my)
            for d in range(lags):
                pred[d:] += (x - mx)[: len(y) - d] @ k[:, lags + d]
            sy = np.convolve(y, shape, mode="same")
            err, sw, swy, swyy = err + w @ (np.maximum(pred, 0) - sy) ** 2, sw + w.sum(), swy + w @ sy, swyy + w @ sy**2
            c = dense_coherence(pred, y, wide)
            hz = np.arange(len(c)) * rate / wide
            bits += -rate / wide * np.log2(1 - c[(hz < 40) & (hz >= round(1 / window))]).sum() * len(y)
            length += len(y)
        assert np.isclose(g["r2cv"], 1 - err / sw / (swyy / sw - (swy / sw) ** 2), atol=1e-9) and np.isclose(g["bits"], bits / length, rtol=1e-6), g
    assert got.best["bits"] == max(g["bits"] for g in got.grid)


def test_frames_defined(spark):
    rows = as_rows(spark, simulated(3, 2, 1))
    clean = direct_fit.frames(rows, "s", "t", "x", "y", "w", 2, 10)
    odd = spark.createDataFrame([(None, 0, [1.0, 1.0], 1.0, 1.0, "c"), ("s0", None, [1.0, 1.0], 1.0, 1.0, "c"), ("s1", 5000, [1.0, None], 1.0, 1.0, "c"), ("s1", 5001, [1.0], 1.0, 1.0, "c"), ("s1", 5002, [9.0, 9.0], None, 1.0, "c"), ("s1", 5003, None, 1.0, 1.0, "c"), ("s1", 5004, [9.0, 9.0], 1.0, None, "c"), ("s1", 5005, [9.0, 9.0], 1.0, -2.0, "c")], rows.schema)
    more = direct_fit.frames(rows.unionByName(odd).unionByName(rows.where("t % 3 = 0")), "s", "t", "x", "y", "w", 2, 10)
    assert np.allclose(clean.layout.means, more.layout.means) and np.isclose(clean.layout.mean_y, more.layout.mean_y)
    a, b = ({(r.p, r.i): r.v for r in direct_fit.products(f, 2).collect()} for f in (clean, more))
    assert a.keys() == b.keys() and all(np.allclose(a[k], b[k]) for k in a if k[1] >= 0)
    for few in (rows.where("s < 's2'"), rows.where("false")):
        with pytest.raises(ValueError, match="three sets"):
            direct_fit.frames(few, "s", "t", "x", "y", "w", 2, 10)
    with pytest.raises(ValueError, match="reach"):
        direct_fit.fit(clean, 20, range(3), [0.1], [0.0])


def test_reach_of_blocks(spark):
    """Frames at a block's edge are in both blocks, once as their own."""
    n = 2 * direct_fit.BLOCK + 5
    rows = spark.range(n).select(F.lit(1).alias("s"), F.col("id").alias("t"), F.array(F.lit(1.0)).alias("x"), F.lit(1.0).alias("y"), F.lit(1.0).alias("w"))
    rows = rows.unionByName(rows.where("t < 9").withColumn("s", F.lit(2))).unionByName(rows.where("t < 9").withColumn("s", F.lit(3)))
    f = direct_fit.frames(rows, "s", "t", "x", "y", "w", 1, 3)
    got = sorted((r.block, len(r.t)) for r in f.blocks.where("n > 9").collect())
    assert got == [(0, direct_fit.BLOCK + 3), (1, direct_fit.BLOCK + 6), (2, 8)]


@pytest.mark.parametrize("tol", [1e-9, 0.3])
def test_separable(spark, monkeypatch, tol):
    monkeypatch.setattr(direct_fit, "BLOCK", 64)
    data, bands, lags = simulated(4, 3, 8), 3, 2
    nt = 2 * lags + 1
    f = direct_fit.frames(as_rows(spark, data), "s", "t", "x", "y", "w", bands, 2 * lags)
    number = {r.p: int(r.s[1:]) for r in f.names.collect()} | {direct_fit.ALL: None}
    got = {(number[r.p], r.i): (np.array(r.h), np.array(r.sd)) for r in direct_fit.separable_filters(f, lags, [tol]).collect()}
    total = sum(w.sum() for _, _, w in data.values())
    mx, my = sum(w @ x for x, _, w in data.values()) / total, sum(w @ y for _, y, w in data.values()) / total
    own = {s: dense_products(x - mx, y - my, w, 2 * lags) for s, (x, y, w) in data.items()}
    a, _, na, _ = (sum(o[j] for o in own.values()) for j in range(4))
    space, course = a[2 * lags] / total, np.trace(a, axis1=1, axis2=2)[2 * lags :] / (bands * na[2 * lags :])
    toeplitz = np.array([[course[abs(i - j)] for j in range(nt)] for i in range(nt)])

    def inverse(c):
        s, u = np.linalg.eigh(c)
        s, u = s[::-1], u[:, ::-1]
        rank = (s > tol * s[0]).sum()
        k = np.arange(1, len(s) + 1) - rank
        return (u * np.where(k > 0, np.exp(-k * k / 8) / (tol * s[0]), 1 / s)) @ u.T

    both = np.kron(inverse(space), inverse(toeplitz))
    if tol < 1e-6:
        assert np.allclose(both, np.linalg.inv(np.kron(space, toeplitz)))
    h = {}
    for p in [None, *data]:
        c, nc = (sum(own[s][j] for s in data if s != p) for j in (1, 3))
        h[p] = (both @ (c / nc)[:, lags : lags + nt].ravel()).reshape(bands, nt) * (np.arctan(np.arange(-lags, lags + 1)) + np.pi / 2) / np.pi
    for p in h:
        others = lambda q: np.std([h[s] for s in data if s != q], axis=0) * np.sqrt(2)
        sd = np.mean([others(q) for q in data], axis=0) if p is None else others(p)
        for i in range(bands):
            assert np.allclose(got[p, i][0], h[p][i]) and np.allclose(got[p, i][1], sd[i])
    assert len(got) == 5 * bands
    with pytest.raises(ValueError, match="reach"):
        direct_fit.separable_filters(f, 3, [tol])


def test_cut_inverse_of_nothing():
    assert not direct_fit.cut_inverse(np.zeros((3, 3)), 0.1).any()
    c = np.diag([4.0, 2.0, 0.1])
    assert np.allclose(direct_fit.cut_inverse(c, 0.1), np.diag([0.25, 0.5, np.exp(-1 / 8) / 0.4]))
