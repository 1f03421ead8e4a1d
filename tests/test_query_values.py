"""Queries without SQL against numpy on the same tables: not only the operators, but how the queries put them together."""

import duckdb
import numpy as np
import pytest

from evokit import catalog
from evokit.operators import direct_fit, event_features, filters, regression, segmented, spectral
from evokit.plans.events import HOURLY_SQL
from tests import test_direct_fit as dense_direct
from tests import test_filters as dense_filters
from tests import test_segmented as dense_segmented

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def vectors():
    t = duckdb.sql(f"SELECT * FROM '{DIR}/embeddings.parquet' ORDER BY vec_id").df()
    return np.stack(t["embedding"].to_numpy()).astype(float), t["label"].to_numpy(), t["vec_id"].to_numpy()


@pytest.fixture(scope="module")
def hours():
    """{band: counts by hour} over the table's span."""
    t = duckdb.sql(f"WITH events AS (SELECT * FROM '{DIR}/events.parquet'), {HOURLY_SQL} SELECT band, t, n FROM hourly ORDER BY band, t").df()
    return {b: g["n"].to_numpy(float) for b, g in t.groupby("band")}


def rows_of(spark, name):
    return catalog.queries()[name](spark, DIR).collect()


def test_components_and_regressions_of_vectors(spark, vectors):
    x, label, _ = vectors
    y = (label % 2).astype(float)
    xc, yc = x - x.mean(0), y - y.mean()
    s, u = np.linalg.eigh(xc.T @ xc / len(x))
    s, u = s[::-1], u[:, ::-1]
    got = rows_of(spark, "pca_top")
    for r in got:
        assert np.isclose(r.variance, s[r.component], atol=1e-5) and np.isclose(abs(r.loading), abs(u[r.d, r.component]), atol=1e-5)
    assert len(got) == 5 * 64
    for r in rows_of(spark, "component_regression"):
        z = xc @ u[:, : r.components]
        h = np.linalg.lstsq(z, yc, rcond=None)[0]
        assert np.isclose(r.r2, 1 - ((yc - z @ h) ** 2).sum() / (yc**2).sum(), atol=1e-5)
    sets = [label == k for k in np.unique(label)]
    cov = lambda m: np.cov(x[m].T, bias=True)
    norm = max(np.linalg.norm(cov(~m)) for m in sets)
    for r in rows_of(spark, "ridge_vectors_loo"):
        error = 0.0
        for m in sets:
            a, b = x[~m], y[~m]
            h = np.linalg.solve(cov(~m) + r.tol * norm * np.eye(64), (a - a.mean(0)).T @ (b - b.mean()) / len(a))
            error += ((y[m] - b.mean() - (x[m] - a.mean(0)) @ h) ** 2).sum()
        assert np.isclose(r.r2cv, 1 - error / (yc**2).sum(), atol=1e-6)
    h = np.zeros(64)
    for r in rows_of(spark, "conjugate_gradient_fit"):
        h[r.d] = r.h
    assert np.allclose(h, np.linalg.solve(xc.T @ xc / len(x) + 0.01 * np.eye(64), xc.T @ yc / len(x)), atol=1e-6)
    z = xc / xc.std(0)
    steps = {}
    for r in rows_of(spark, "lars_path"):
        steps.setdefault(r.step, np.zeros(64))[r.d] = r.h
    for k, h in steps.items():  # variables that are in have equal correlations with what is left, and no other has a larger one
        c = abs(z.T @ (yc - xc @ h))
        on = np.flatnonzero(h)
        assert len(on) == k and np.ptp(c[on]) < 1e-6 * c.max() + 1e-9 and c.max() <= c[on].max() * (1 + 1e-9)
    knots = {}
    for r in rows_of(spark, "lasso_path"):
        knots.setdefault((r.kind, r.knot), (r.penalty, np.zeros(64)))[1][r.d] = r.h
    for (kind, _), (penalty, h) in knots.items():
        c = z.T @ (yc - xc @ h) / len(x) - (0.5 if kind != "lasso" else 0) * h * xc.std(0)
        assert np.all(abs(c) <= penalty + 1e-6) and np.allclose(abs(c[h != 0]), penalty, atol=1e-6)


def test_scaled_blocks(spark, vectors):
    x, label, _ = vectors
    y = (label % 2).astype(float)
    xc, yc = x - x.mean(0), y - y.mean()
    got = sorted(rows_of(spark, "group_ridge_fit"), key=lambda r: r.d)
    scale = np.sqrt([r.scale for r in got])
    a = xc * scale
    h = np.linalg.solve(a.T @ a / len(x) + 0.01 * np.eye(64), a.T @ yc / len(x)) * scale
    assert np.allclose([r.h for r in got], h) and np.isclose(sum({r.scale for r in got}), 1)


def test_odd_labels(spark, vectors):
    x, label, ids = vectors
    got = {r.vec_id: (r.p, r.prediction) for r in rows_of(spark, "logistic_labels")}
    p = np.array([got[i][0] for i in ids])
    y = label % 2
    # On scaled features, as the library fits them, the penalised gradient is 0 at the minimum; a linear score gives it back.
    score = np.log(p / (1 - p))
    w, *_ = np.linalg.lstsq(np.column_stack((x, np.ones(len(x)))), score, rcond=None)
    assert np.allclose(np.column_stack((x, np.ones(len(x)))) @ w, score, atol=1e-6)
    loss = lambda w: np.mean(np.log1p(np.exp(-np.where(y, 1, -1) * (x @ w[:-1] + w[-1])))) + 0.005 * ((w[:-1] * x.std(0, ddof=1)) ** 2).sum()
    r = np.random.default_rng(1)
    assert all(loss(w) <= loss(w + 0.05 * r.normal(size=65)) for _ in range(200)) and all(got[i][1] == (got[i][0] > 0.5) for i in ids)


def test_error_searches(spark, hours):
    x = np.column_stack((hours["view"][:-1], hours["click"][:-1], np.ones(len(hours["view"]) - 1)))
    y = hours["purchase"][1:]
    weights = {}
    for name, hit in (("glm_poisson", False), ("glm_logistic", True), ("scaled_conj_grad", False)):
        w = weights[name] = np.array([r.weight for r in sorted(rows_of(spark, name), key=lambda r: r.term)])
        mean = 1 / (1 + np.exp(-x @ w)) if hit else np.exp(x @ w)
        assert np.abs(x.T @ (mean - (y > 2 if hit else y))).max() / len(y) < 1e-4, name
    assert np.allclose(weights["glm_poisson"], weights["scaled_conj_grad"], atol=1e-5)
    rows = rows_of(spark, "grad_line_search")
    w = np.array([r.weight for r in sorted(rows, key=lambda r: r.term)]) / [10, 10, 1]
    error = lambda w: np.mean(np.exp(x @ w) - y * (x @ w))
    assert np.isclose(error(w), rows[0].error) and error(weights["glm_poisson"]) <= rows[0].error < error(weights["glm_poisson"]) + 0.01


def frames_of(hours):
    bands = sorted(b for b in hours if b != "purchase")
    x, y = np.column_stack([hours[b] for b in bands]), hours["purchase"]
    return bands, {s: (x[s * 144 : (s + 1) * 144], y[s * 144 : (s + 1) * 144], np.ones(len(y[s * 144 : (s + 1) * 144]))) for s in range(-(-len(y) // 144))}


def test_receptive_fields(spark, hours):
    bands, data = frames_of(hours)
    h, sd, _, _ = dense_direct.dense_fit(data, 12, [0.01])
    got = rows_of(spark, "receptive_field_fit")
    assert len(got) == (len(data) + 1) * len(bands) * 25
    for r in got:
        at = 0, bands.index(r.band), r.lag + 12
        assert np.isclose(r.h, h[r.s][at], atol=1e-8) and np.isclose(r.sd, sd[r.s][at], atol=1e-8)


def test_direct_fit(spark, hours):
    _, data = frames_of(hours)
    tolerances = list(direct_fit.TOLERANCES)
    h, sd, mx, my = dense_direct.dense_fit(data, 12, tolerances)
    shape = np.hanning(5) / np.hanning(5).sum()
    got = rows_of(spark, "direct_fit_lagged")
    assert len(got) == 32 and sum(r.best for r in got) == 1 and max(got, key=lambda r: r.bits).bits == next(r.bits for r in got if r.best)
    for r in got:
        err = n = sy = syy = bits = 0.0
        for s, (x, y, _) in data.items():
            if len(y) < 48 or not y.any():
                continue
            k = direct_fit.shrunk(h[s][tolerances.index(r.tol)], sd[s][tolerances.index(r.tol)], r.sparseness)
            pred = np.full(len(y), my)
            for d in range(12):
                pred[d:] += (x - mx)[: len(y) - d] @ k[:, 12 + d]
            z = np.convolve(y, shape, mode="same")
            err, n, sy, syy = err + ((np.maximum(pred, 0) - z) ** 2).sum(), n + len(y), sy + z.sum(), syy + (z**2).sum()
            c = dense_direct.dense_coherence(pred, y, 24)
            bits += -np.log2(1 - c[1:10]).sum() * len(y)
        assert np.isclose(r.r2cv, 1 - err / n / (syy / n - (sy / n) ** 2), atol=1e-7) and np.isclose(r.bits, bits / n, rtol=1e-5), r


def event_design(hours, kinds, length):
    x = np.zeros((len(hours["purchase"]), len(kinds) * length))
    for i, b in enumerate(kinds):
        for k in range(length):
            x[k:, i * length + k] = hours[b][: len(x) - k] > 0
    return x


def as_sets(x, y):
    return {f"{s:03d}": (x[s * 144 : (s + 1) * 144], y[s * 144 : (s + 1) * 144], np.ones(len(y[s * 144 : (s + 1) * 144]))) for s in range(-(-len(y) // 144))}


def test_segmented_models(spark, hours):
    x, y = event_design(hours, ["view", "click"], 6), hours["purchase"]
    scores, best, h, bias, _ = dense_segmented.dense(as_sets(x, y), list(segmented.TOLERANCES), regression.near_diagonal_inverse, True, True)
    got = sorted(rows_of(spark, "fit_seg_loo"), key=lambda r: (r.kind == "click", r.k))
    assert np.allclose([r.weight for r in got], h, atol=1e-7) and {r.tol for r in got} == {segmented.TOLERANCES[best]} and np.isclose(got[0].bias, bias, atol=1e-7) and np.isclose(got[0].r2cv, scores[best], atol=1e-7)
    more = np.zeros((len(y), 6))
    for i, b in enumerate(("error", "signup")):
        for k in range(3):
            more[k:, i * 3 + k] = np.log1p(hours[b])[: len(y) - k]
    tolerances = [0.6, 0.5, 0.4, 0.2, 0.15, 0.1, 0.08, 0.05, 0.01, 0.005, 1e-3]
    one = dense_segmented.dense(as_sets(x, y), tolerances, dense_segmented.ridge, False, False)
    base = {s: a @ one[2] + one[3] for s, (a, _, _) in as_sets(x, y).items()}
    two = dense_segmented.dense(as_sets(more, y), tolerances, dense_segmented.ridge, False, False, base)
    rows = rows_of(spark, "fit_seg_staged")
    for stage, fit in ((1, one), (2, two)):
        got = sorted((r for r in rows if r.stage == stage), key=lambda r: r.feature)
        assert np.allclose([r.weight for r in got], fit[2], atol=1e-7) and np.isclose(got[0].bias, fit[3], atol=1e-7) and np.isclose(got[0].r2cv, fit[0][fit[1]], atol=1e-7)


def test_filtered_hours(spark, hours):
    both = lambda v, s: dense_filters.loop(dense_filters.loop(v, s)[::-1], s)[::-1]
    notches = np.concatenate([filters.notch_section(float(k), 24.0, 10.0) for k in range(1, 7)])
    band, above, slow = filters.butterworth(10, 24.0, 1.0, 6.0), filters.butterworth(10, 24.0, low=6.0), filters.butterworth(4, 24.0, 0.1, 2.0)

    def envelope(v):
        high = both(v, above)
        return both(abs(high - high.mean()), slow)

    for name, f in (("notch_harmonics", lambda v: dense_filters.loop(v, notches)), ("bandpass_butter", lambda v: both(v, band)), ("envelope_fast", envelope)):
        got = {}
        for r in rows_of(spark, name):
            got.setdefault(r.band, {})[r.i] = r.value
        assert got.keys() == hours.keys()
        for b, v in hours.items():
            assert np.allclose([got[b][i] for i in range(len(v))], f(v), atol=2e-6), name


def test_event_windows(spark, hours):
    bands = sorted(hours)
    x = np.log1p(np.column_stack([hours[b] for b in bands]))
    padded = np.vstack((x, np.zeros((6, len(bands)))))
    windows = {(b, t): padded[t : t + 6].ravel() for b in ("purchase", "signup") for t in np.flatnonzero(hours[b] > 0).tolist()}
    w = np.array(list(windows.values()))
    c = np.cov(w.T, bias=True)
    s, u = np.linalg.eigh(c)
    u = u[:, ::-1][:, :4]
    scores = {}
    for r in rows_of(spark, "pca_events"):
        assert r.k // 4 == (r.kind == "signup")
        scores.setdefault((r.kind, r.t), np.zeros(4))[r.k % 4] = r.v
    assert scores.keys() == windows.keys()
    assert all(np.allclose(abs(v), abs((windows[k] - w.mean(0)) @ u), atol=1e-4) for k, v in scores.items())
    power = {k: abs(np.fft.fft2(v.reshape(6, -1) - v.mean())) ** 2 for k, v in windows.items()}
    mean = np.mean(list(power.values()), axis=0)
    rows = rows_of(spark, "event_modulation")
    assert len(rows) == 10 * len(windows)
    assert all(np.isclose(r.power, (power[r.kind, r.t] - mean)[r.k % 6, r.l], atol=1e-5) for r in rows)


def test_movie_of_vectors(spark, vectors):
    x, _, ids = vectors
    n = int(ids.max()) + 1
    movie = np.zeros((n, 8, 8))
    movie[ids] = x.reshape(-1, 8, 8)
    mask = event_features.fade(8, 0.05)[:, None, None] * event_features.fade(8, 0.05)[None, :, None] * event_features.fade(6, 0.05)
    got = {}
    for r in rows_of(spark, "movie_fourier"):
        got.setdefault(r.vec_id, np.zeros(256))[r.k] = r.v
    assert len(got) == len(ids)
    for t in ids[:: 37].tolist() + [0, n - 1]:
        cube = movie[(np.arange(6) + t - 2) % n].transpose(1, 2, 0) * mask
        assert np.allclose(got[t], abs(np.fft.fftshift(np.fft.fftn(cube)))[:, :, -4:].ravel(), atol=2e-5), t


def smoothed(v, n=7):
    k = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / (n - 1))
    return np.convolve(v, k / k.sum(), mode="same")


def dense_snr(sets, rate, window):
    """Signal and noise by frequency from {key: (a, b, trials)}, set by set."""
    shape = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(window) / window)
    f = np.arange(window // 2 + 1) * rate / window
    clean = lambda c: np.where(c - c[f >= rate / 4].mean() < 2 * c[f >= rate / 4].std(), 0, c - c[f >= rate / 4].mean())
    signal = noise = 0.0
    for a, b, k in sets.values():
        if a.var() == 0 or b.var() == 0:
            continue
        xy, xx, yy, p = 0, 0, 0, []
        for s in range(0, len(a) - window + 1, window // 2):
            fa, fb, fc = (np.fft.rfft(shape * (v[s : s + window] - v[s : s + window].mean())) for v in (a, b, a + b))
            xy, xx, yy = xy + fa * fb.conj(), xx + abs(fa) ** 2, yy + abs(fb) ** 2
            one = abs(fc) ** 2 / (rate * (shape**2).sum())
            one[1:-1] *= 2
            p.append(one)
        c = clean(abs(xy) ** 2 / (xx * yy))
        power = np.mean(p, axis=0) / k**2
        n = power / (1 + 2 * np.sqrt(c) / (1 - np.sqrt(c)) / k)
        signal, noise = signal + (power - n) * len(a) * k, noise + n * len(a) * k
    c = clean(signal / (signal + noise))
    return c / (1 - c)


def test_snr_by_frequency(spark):
    t = duckdb.sql(f"SELECT event_type AS band, user_id, epoch_us(ts) // 3600000000 AS h FROM '{DIR}/events.parquet'").df()
    span, sets = np.arange(t.h.min(), t.h.max() + 1), {}
    for b, g in t.groupby("band"):
        sides = [smoothed(np.array([((g.h == h) & (g.user_id % 2 == k)).sum() for h in span], float)) for k in (0, 1)]
        sets[b] = (*sides, g.user_id.nunique() // 2 * 2)
    snr = dense_snr(sets, 24.0, 64)
    got = sorted(rows_of(spark, "snr_by_frequency"), key=lambda r: r.f)
    assert np.allclose([r.snr for r in got], snr, atol=2e-6)
    assert np.allclose([r.total for r in got], np.cumsum(np.log2(1 + snr) * 24 / 64), atol=1e-5)


def test_snr_spectrum_finds_the_signal(spark):
    """A tone in every trial stands out at its frequency; keys that don't vary or are too short are left out."""
    r = np.random.default_rng(3)
    n, k = 1024, 10
    tone = np.sin(2 * np.pi * np.arange(n) * 6 / 64)
    sides = [k / 2 * tone + np.sqrt(k / 2) * r.normal(size=n) for _ in "ab"]
    rows = [("x", i, float(sides[0][i]), float(sides[1][i]), k) for i in range(n)] + [("flat", i, 1.0, 1.0, 4) for i in range(200)] + [("short", i, float(i), float(-i), 4) for i in range(30)]
    got = spectral.snr_spectrum(spark.createDataFrame(rows, "s string, t long, x double, y double, k int"), "s", "t", "x", "y", "k", 64.0, 64).collect()
    snr = np.array([g.snr for g in sorted(got, key=lambda g: g.f)])
    assert np.allclose(snr, dense_snr({"x": (*sides, k)}, 64.0, 64)) and snr.argmax() == 6 and snr[6] > 5 and snr[20:].max() < 0.5


def test_coherence_info(spark, hours):
    for r in rows_of(spark, "coherence_info"):
        a, b = hours[r.band], hours["click"]
        c = dense_direct.dense_coherence(a - a.mean(), b - b.mean(), 128)
        at = (np.arange(len(c)) * 24 / 128 >= 1) & (np.arange(len(c)) * 24 / 128 < 11)
        assert np.isclose(r.coherence, c[at].mean(), atol=1e-5) and np.isclose(r.bits, -24 / 128 * np.log2(1 - c[at]).sum(), rtol=1e-4) and r.bits_lower <= r.bits <= r.bits_upper
