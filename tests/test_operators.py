import math
import random
import wave

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as hs
from pyspark.sql import functions as F

from evokit import catalog
from evokit.functions import scalars
from evokit.operators import components, encoders, filters, histograms, intervals, regression, sequences, spectral, statistics
from evokit.plans import streams
from evokit.sources import readers, writers
from evokit.streaming import windows


def test_range_join_is_half_open(spark):
    r = random.Random(1)
    pts = [(r.randrange(3), r.randrange(1000)) for _ in range(300)]
    iv = [(k, i, a, a + r.randrange(0, 120)) for i, (k, a) in enumerate((r.randrange(3), r.randrange(950)) for _ in range(60))]
    p, i = spark.createDataFrame(pts, "k int, t long"), spark.createDataFrame(iv, "k int, i int, a long, z long")
    got = sorted((x.k, x.i, x.t) for x in intervals.points_in_intervals(p, i, "k", "t", "a", "z", 50).collect())
    assert got == sorted((k, n, t) for k, n, a, z in iv for pk, t in pts if pk == k and a <= t < z)


def test_containment_is_strict(spark):
    t = spark.createDataFrame([(1, 10, 20), (2, 11, 19), (3, 11, 20)], "id int, a int, z int").withColumn("k", F.lit(1))
    u = spark.createDataFrame([(1, 10, 20)], "k int, s int, e int")
    assert [x.id for x in intervals.contained(t, u, "k", "a", "z", "s", "e").collect()] == [2]


def test_sessions_break_over_the_gap(spark):
    rows = spark.createDataFrame([(1, 0, 5), (1, 15, 20), (1, 31, 33), (2, 100, 101)], "k int, s long, e long")
    got = [(x.k, x.s, x.gap, x.session) for x in intervals.sessions(rows, "k", "s", "e", 10).orderBy("k", "s").collect()]
    assert got == [(1, 0, 0, 0), (1, 15, 10, 0), (1, 31, 11, 1), (2, 100, 0, 0)]


@settings(max_examples=12, deadline=None)
@given(hs.lists(hs.integers(0, 1), min_size=1, max_size=60), hs.integers(0, 4))
def test_long_runs(spark, values, longer):
    runs, a = [], None
    for i, v in enumerate([*values, 1]):
        if v == 0 and a is None:
            a = i
        if v and a is not None:
            if i - a > longer:
                runs.append((a, i))
            a = None
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate(values)], "k int, t int, v int")
    assert sorted((x.start, x.stop) for x in intervals.long_runs(df, "k", "t", "v", longer).collect()) == runs


def test_histogram_with_ragged_trials(spark):
    trials = spark.createDataFrame([(1, 1, 0, 1000), (1, 2, 0, 2500), (2, 3, 0, 400)], "k int, trial int, a long, z long")
    spikes = spark.createDataFrame([(1, 1, 500), (1, 2, 1500), (1, 2, 1600), (1, 2, 2499)], "k int, trial int, o long")
    h = {(x.k, x.bin): (x.n_spikes, x.weight, x.rate) for x in histograms.histogram(spikes, trials, "k", "o", "a", "z", 1000, 3).collect()}
    assert h == {(1, 0): (1, 2, 0.5), (1, 1): (0, 2, 0.0), (1, 2): (3, 1, 3.0), (2, 0): (0, 1, 0.0), (2, 1): (0, 0, 0.0), (2, 2): (0, 0, 0.0)}
    m = {(x.k, x.bin): x.mean for x in histograms.binary_mean(spikes, trials, "k", "trial", "o", 1000, 3).collect()}
    assert m == {(1, 0): 0.5, (1, 2): 0.5}


def test_total_minus_own_is_anti_join(spark):
    r = np.random.default_rng(0)
    rows = [(int(g), float(x)) for g, x in zip(r.integers(0, 6, 200), r.normal(size=200), strict=True)]
    got = {x.g: x.rest_s for x in statistics.total_minus_own(spark.createDataFrame(rows, "g int, x double"), ["g"], [], {"s": F.sum("x")}).collect()}
    for g in got:
        assert math.isclose(got[g], sum(x for h, x in rows if h != g), abs_tol=1e-9)


def test_moments_with_unit_weights_are_population_moments(spark):
    df = spark.range(100).select((F.col("id") % 7).cast("double").alias("x"), (F.col("id") * F.col("id") % 11).cast("double").alias("y"))
    m = statistics.weighted_moments(F.col("x"), F.col("y"), F.lit(1.0))
    a = df.agg(*(c.alias(k) for k, c in m.items()), F.covar_pop("x", "y").alias("c"), F.corr("x", "y").alias("r")).first()
    assert math.isclose(a.cov_xy, a.c) and math.isclose(a.corr_xy, a.r)


def test_smoothing_is_convolution(spark):
    v = np.random.default_rng(2).normal(size=40)
    df = spark.createDataFrame([(1, i, float(x)) for i, x in enumerate(v)], "k int, t int, v double")
    h = sequences.hann(7)
    got = [x.smooth for x in sequences.smooth(df, "k", "t", "v", h).orderBy("t").collect()]
    assert np.allclose(got, np.convolve(v, h, "same"))
    ahead = [x.smooth for x in sequences.smooth(df, "k", "t", "v", h, 1).orderBy("t").collect()]
    assert np.allclose(ahead[:-1], got[1:])


def test_peaks_are_pruned_highest_first(spark):
    r = np.random.default_rng(3)
    v = [(1, i, float(x)) for i, x in enumerate(r.normal(size=300))]
    peaks = sequences.local_maxima(spark.createDataFrame(v, "k int, t int, v double"), "k", "t", "v", 0.0)
    all_peaks = sorted((x.t, x.v) for x in peaks.collect())
    left, kept = sorted(all_peaks, key=lambda p: -p[1]), []
    while left:
        kept.append(left[0][0])
        left = [p for p in left if abs(p[0] - kept[-1]) >= 8]
    assert sorted(x.t for x in sequences.pruned_peaks(peaks, "k", "t", "v", 8).collect()) == sorted(kept)


def test_forward_and_design_agree(spark):
    ev = [(1, "on", 3, 2.0), (1, "on", 7, 1.0)]
    df = spark.createDataFrame(ev, "k int, kind string, t int, v double")
    w = [0.5, -1.0, 0.25]
    d = sequences.impulse_design(df, "k", "kind", "t", F.col("v"), 3, 12).collect()
    pred = np.zeros(12)
    for x in d:
        pred[x.t] += w[x.k] * x.x
    full = np.zeros(12)
    for _, _, t, v in ev:
        full[t] = v
    assert np.allclose(pred, np.convolve(full, w)[:12])
    series = spark.createDataFrame([(1, i, float(x)) for i, x in enumerate(full)], "k int, t int, v double")
    kernel = spark.createDataFrame(list(enumerate(w)), "d int, w double")
    assert np.allclose([x.pred for x in sequences.convolve(series, kernel, "k", "t", "v").orderBy("t").collect()], pred)


def test_fourier_and_coherence(spark):
    v = np.random.default_rng(4).normal(size=64)
    df = spark.createDataFrame([(0, i, float(x)) for i, x in enumerate(v)], "c int, u int, v double")
    got = spectral.fourier(df, ["c"], "u", "v", 64).orderBy("f").collect()
    assert np.allclose([complex(x.re, x.im) for x in got], np.fft.rfft(v))
    ft = spectral.fourier(spectral.chunked(df.withColumnRenamed("u", "t"), "t", 16).drop("c"), ["chunk"], "u", "v", 16)
    assert all(math.isclose(x.coherence, 1.0) for x in spectral.coherence(ft, ft, ["chunk"]).collect())


def test_tapers_and_multitaper(spark):
    t = spectral.slepian_tapers(64, 3.0, 5)
    assert np.allclose(t @ t.T, np.eye(5))
    r = np.random.default_rng(5)
    x = r.normal(size=1024)
    y = np.convolve(x, [0.2, 0.5, 0.2], "same") + 0.1 * r.normal(size=1024)
    rows = [(k, i, float(a), float(b)) for k, (p, q) in enumerate(((x, y), (x, r.normal(size=1024)))) for i, (a, b) in enumerate(zip(p, q, strict=True))]
    got = spectral.multitaper_coherence(spark.createDataFrame(rows, "k int, t int, x double, y double"), "k", "t", "x", "y", 128).toPandas()
    assert (got.lower <= got.coherence + 1e-12).all() and (got.coherence <= got.upper + 1e-12).all()
    low = got[(got.f > 2) & (got.f < 20)].groupby("k").coherence.mean()
    assert low[0] > 0.9 > 0.3 > low[1]


def test_windowed_spectra_are_those_of_the_series(spark):
    r = np.random.default_rng(11)
    series = {1: r.normal(size=(150, 2)), 2: r.normal(size=(97, 2)), 3: r.normal(size=(9, 2))}
    rows = [(k, i, float(a), float(b)) for k, v in series.items() for i, (a, b) in enumerate(v)]
    df = spark.createDataFrame(rows, "k int, t int, x double, y double").repartition(3)
    got = {(g.k, g.frame, g.f): g.power_db for g in spectral.gaussian_spectrogram(df, "k", "t", "x", 16, 5).collect()}
    shape = np.exp(-0.5 * ((np.arange(16) - 7.5) / (16 / 6)) ** 2)
    want = {}
    for k, v in series.items():
        p = np.pad(v[:, 0], 8)
        for n, s in enumerate(range(0, len(p) - 15, 5)):
            want |= {(k, n, f): x for f, x in enumerate(20 * np.log10(np.maximum(abs(np.fft.rfft(shape * p[s : s + 16])), 1e-12)))}
    assert got.keys() == want.keys() and all(abs(got[c] - want[c]) < 1e-8 for c in want)

    got = {(g.k, g.f): (g.coherence, g.lower, g.upper) for g in spectral.multitaper_coherence(df, "k", "t", "x", "y", 32).collect()}
    tapers = spectral.slepian_tapers(32, 3.0, 5)
    assert {k for k, _ in got} == {1, 2}
    for k in (1, 2):
        a, b = (series[k] - series[k].mean(0)).T
        s = []
        for i in range(0, len(a) - 31, 16):
            fa, fb = np.fft.rfft(tapers * a[i : i + 32], axis=1), np.fft.rfft(tapers * b[i : i + 32], axis=1)
            s.append(((fa * fb.conj()).mean(0), (abs(fa) ** 2).mean(0), (abs(fb) ** 2).mean(0)))
        n = len(s)
        z = lambda parts: np.arctanh(abs(sum(p[0] for p in parts)) / np.sqrt(sum(p[1] for p in parts) * sum(p[2] for p in parts)))
        pseudo = np.array([n * z(s) - (n - 1) * z(s[:i] + s[i + 1 :]) for i in range(n)])
        mean, error = pseudo.mean(0), pseudo.std(0, ddof=1) / n**0.5
        for f in range(17):
            assert np.allclose(got[k, f], [np.tanh(max(v, 0)) ** 2 for v in (mean[f], mean[f] - 2 * error[f], mean[f] + 2 * error[f])], atol=1e-9)


def test_smoothing_in_runs_is_smoothing_of_the_series(spark):
    v = np.random.default_rng(12).normal(size=50)
    df = spark.createDataFrame([(1, i, float(x)) for i, x in enumerate(v)], "k int, t int, v double")
    h = [0.1, 0.3, 0.2, 0.3, 0.1]
    for shift in (0, 1, -4):
        got = [(x.t, x.smooth) for x in sequences.smooth(df, "k", "t", "v", h, shift, width=3).orderBy("t").collect()]
        want = [sum(w * v[t + 2 - k + shift] for k, w in enumerate(h) if 0 <= t + 2 - k + shift < 50) for t in range(50)]
        assert [t for t, _ in got] == list(range(50)) and np.allclose([x for _, x in got], want)


def test_stream_bins_over_batches(spark, tmp_path):
    schema = "event_id long, event_type string, user_id long, value double, s long"
    parts = [[(1, "a", 1, 1.0, 10), (2, "a", 1, 1.0, 4000)], [(3, "a", 1, 1.0, 30), (4, "b", 1, 1.0, 90_000)], [(5, "a", 1, 1.0, 40), (6, "a", 1, 1.0, 90_001)], [(7, "a", 1, 1.0, 50)]]
    path = str(tmp_path / "events.parquet")
    for p in parts:
        spark.createDataFrame(p, schema).coalesce(1).withColumn("ts", F.timestamp_seconds("s")).write.mode("append").parquet(path)

    def counts(rows):
        out = streams._drained(spark, windows.binned_counts(rows, "ts", "event_type", "1 hour", "1 hour"), ["event_type", "start"])
        return sorted((x.event_type, x.start.timestamp() // 3600, x.n) for x in out.collect())

    assert counts(streams._stream(spark, str(tmp_path))) == [("a", 0, 4), ("a", 1, 1), ("a", 25, 1), ("b", 25, 1)]
    # A file a batch: the row at 50 s comes a batch after the watermark has passed its hour.
    slow = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 1).parquet(path)
    assert counts(slow) == [("a", 0, 3), ("a", 1, 1), ("a", 25, 1), ("b", 25, 1)]


def test_filters(spark):
    t = np.arange(480)
    df = spark.createDataFrame([(1, int(i), float(3 + np.sin(2 * np.pi * i / 24))) for i in t], "k int, t int, v double")
    out = filters.filtered(df, "k", "t", "v", filters.notch_section(1.0, 24.0, 2.0)).toPandas().sort_values("i")
    assert abs(out["value"].iloc[-48:] - 3).max() < 0.05
    assert spectral.resampled(df, "k", "t", "v", 0.5).count() == 240


def _frame(spark, n=400):
    r = np.random.default_rng(6)
    x = r.normal(size=(n, 3))
    y = x @ [1.0, -2.0, 0.5] + 3 + 0.1 * r.normal(size=n)
    w = r.uniform(0.5, 2, n)
    rows = [(int(i % 5), *map(float, x[i]), float(y[i]), float(w[i]), [float(v) for v in x[i]]) for i in range(n)]
    return spark.createDataFrame(rows, "s int, a double, b double, c double, y double, w double, v array<double>"), x, y, w


def test_regressions_recover_truth(spark):
    df, x, y, w = _frame(spark)
    by = regression.moments(df, ["a", "b", "c"], "y", "w", "s")
    m = regression.total(by)
    coef, bias = regression.ridge(m, 0.0)
    d = np.column_stack((x, np.ones(len(x)))) * np.sqrt(w)[:, None]
    assert np.allclose([*coef, bias], np.linalg.lstsq(d, y * np.sqrt(w), rcond=None)[0])
    assert np.allclose(regression.conjugate_gradient(m, 10), coef)
    assert np.allclose(regression.lars(m, 3)[-1][1], coef)
    assert np.allclose(regression.gradient_descent(m, 0.3, 300)[-1], coef, atol=1e-4)
    assert regression.ridge_loo(by, [0.0, 10.0])[0]["r2cv"] > 0.99 > regression.ridge_loo(by, [0.0, 10.0])[1]["r2cv"]
    arrays = regression.total(regression.array_moments(df, "v", "y", "s"))
    plain = regression.total(regression.moments(df, ["a", "b", "c"], "y", F.lit(1.0), "s"))
    assert np.allclose(arrays.products, plain.products) and arrays.rows == plain.rows
    s, u = regression.principal_components(plain, 2)
    assert np.allclose(s, np.sort(np.linalg.eigvalsh(np.cov(x.T, bias=True)))[::-1][:2]) and np.allclose(u.T @ u, np.eye(2))
    h, _ = regression.group_ridge(plain, [[0], [1, 2]], 50, 1e-6)
    assert np.allclose(h, [1.0, -2.0, 0.5], atol=0.05)
    assert np.allclose(regression.shrunk_diagonal_inverse(np.diag([2.0, 4.0]), 0.3), np.diag([0.5, 0.25]))


def test_flat_tops_count_once(spark):
    values = [0, 2, 2, 2, 1, 3, 3, 0, 5, 5, 6, 6, 6, 6, 1, 4]
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate(values)] + [("b", 0, 9)], "k string, t long, v long")
    assert sorted((x.t, x.v) for x in sequences.plateau_peaks(df, "k", "t", "v", 2).collect()) == [(2, 2), (5, 3), (11, 6)]
    events = sorted((x.t, x.onset, x.offset, round(x.value, 3)) for x in sequences.onset_offset_events(df, "k", "t", "v", 1).collect())
    rise = [b - a for a, b in zip(values, values[1:])]
    expected = []
    for kind, d in ((1, rise), (0, [-x for x in rise])):
        peaks = []
        for i in range(1, len(d) - 1):
            z = i
            while z + 1 < len(d) and d[z + 1] == d[i]:
                z += 1
            if d[i - 1] < d[i] and z + 1 < len(d) and d[z + 1] < d[i] and d[i] >= 1:
                peaks.append(((i + z) // 2, d[i]))
        expected += [(t, kind, 1 - kind, round(v / max(v for _, v in peaks), 3)) for t, v in peaks]
    assert events == sorted(expected)


def test_containment_spreads_over_buckets(spark):
    r = random.Random(12)
    trials = [(r.randrange(2), i, a, a + r.randrange(1, 40)) for i, a in enumerate(r.randrange(500) for _ in range(200))]
    spans = [(r.randrange(2), a, a + r.randrange(0, 90)) for a in (r.randrange(500) for _ in range(40))]
    t, u = spark.createDataFrame(trials, "k int, id int, a long, z long"), spark.createDataFrame(spans, "k int, s long, e long")
    got = sorted(x.id for x in intervals.contained(t, u, "k", "a", "z", "s", "e", 25).collect())
    assert got == [i for k, i, a, z in trials if any(k == k2 and s < a and e > z for k2, s, e in spans)]


def test_group_bootstrap_keeps_groups_together(spark):
    rows = spark.createDataFrame([(i, i % 20) for i in range(4000)], "id long, g long")
    out = statistics.group_bootstrap(rows, "g", "id", 5, 0.1).toPandas()
    assert len(out) == 20000 and (out[out.test].groupby("draw").g.nunique() == 2).all() and not set(map(tuple, out[out.test][["draw", "g"]].values)) & set(map(tuple, out[~out.test][["draw", "g"]].values))
    assert abs(out.w.mean() - 1) < 0.03 and abs(out.w.var() - 1) < 0.06


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (101, 99), (7, 7), (None, 3)]
    got = {x.node: x.component for x in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {99: 99, 100: 99, 101: 99}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_with_hubs(spark, monkeypatch):
    monkeypatch.setattr(components, "HUB", 30)
    edges = [(5, 1000 + i) for i in range(200)] + [(1000 + i, 3000 + i) for i in range(150)] + [(3000 + i, 3 if i == 7 else 5000 + i) for i in range(40)] + [(9000 + i, 8000) for i in range(60)]
    got = {x.node: x.component for x in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = {v for e in edges for v in e}
    assert got == {v: 8000 if v >= 8000 else 3 for v in nodes}


def test_encoders_and_scalars(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), (None,), ("c",)], "v string")
    assert [(x.v, x.code) for x in encoders.label_codes(df, "v").orderBy("code").collect()] == [("a", 0), ("b", 1), ("c", 2)]
    with pytest.raises(ValueError):
        encoders.label_codes(df, "v", most=2)
    hot = encoders.one_hot_top(df, "v", 1).collect()
    assert sum(x.hot_1 for x in hot) == 2 and sum(x.hot_rest for x in hot) == 3
    place = lambda i, n: spark.range(1).select(scalars.sentence_position(F.lit(i), F.lit(n))).first()[0]
    assert [place(i, 6) for i in range(7)] == [0, 1, 2, 0, 3, 4, 5] and [place(i, 1) for i in (0, 1)] == [0, 5]
    v = spark.range(1).select(scalars.half_even(F.lit(2.5)), scalars.half_away(F.lit(2.5)), scalars.saturate(F.lit(1.5)), scalars.decibels(F.lit(0.0), F.lit(1.0))).first()
    assert tuple(v) == (2.0, 3.0, 1.0, 0.0)


def test_sources(spark, tmp_path):
    (tmp_path / "spike1").write_text("1.5 2.5\n\n3 -1\n")
    (tmp_path / "spike2").write_text("9\n")
    (tmp_path / "stim1").write_text("a.wav\nrest")
    trains = readers.spike_text(spark, f"{tmp_path}/spike*")
    assert sorted((x.number, x.repetition, x.spike_times) for x in trains.collect()) == [(1, 0, [1.5, 2.5]), (1, 1, []), (1, 2, [3.0, -1.0]), (2, 0, [9.0])]
    assert sorted(tuple(x) for x in readers.spike_raster(trains, 5).collect()) == [(1, 0, 3), (1, 0, 4), (1, 2, 4)]
    pairs, alone = readers.stimulus_pairs(spark, f"{tmp_path}/stim*", f"{tmp_path}/spike*")
    assert {(x.number, x.sound) for x in pairs.collect()} == {(1, "a.wav")} and [x.number for x in alone.collect()] == [2]
    with wave.open(str(tmp_path / "s.wav"), "wb") as w:
        w.setnchannels(2), w.setsampwidth(2), w.setframerate(8000)
        w.writeframes(np.array([[0, 16384], [-32768, 0]], "<i2").tobytes())
    clips = {x.channel: (x.rate, x.samples) for x in readers.load(spark, str(tmp_path / "s.wav")).collect()}
    assert clips == {0: (8000, [0.0, -1.0]), 1: (8000, [0.5, 0.0])}
    with pytest.raises(TypeError):
        readers.load(spark, "x.unknown")
    writers.electrode_configs(spark, str(tmp_path / "c"), 3, {"points": 120})
    assert spark.read.json(str(tmp_path / "c")).count() == 3


def test_all_channels(spark):
    r = np.random.default_rng(5)
    x = r.normal(3, 1, (70, 20)).tolist()
    x[3][19] = None
    x[4] = x[4][:15]
    frames = spark.createDataFrame([(i, v) for i, v in enumerate([*x, None, []])], "id long, v array<double>").repartition(3)
    got = {(c.d1, c.d2): (c.cov, c.n) for c in statistics.pair_covariances(frames, "v").collect()}
    assert len(got) == 20 * 21 // 2
    for (i, j), (cov, n) in got.items():
        both = [(v[i - 1], v[j - 1]) for v in x if len(v) >= j and v[i - 1] is not None and v[j - 1] is not None]
        assert n == len(both) and abs(cov - np.cov(np.array(both).T, bias=True)[0, 1]) < 1e-9
    near = {(p.id, p.d1, p.d2): p.p for p in statistics.near_products(frames, "id", "v", 2).collect()}
    assert set(near) == {(k, i + 1, j + 1) for k, v in enumerate(x) for i in range(len(v)) for j in range(i, min(i + 3, len(v)))}
    assert near[0, 18, 20] == x[0][17] * x[0][19] and near[3, 20, 20] is None


def test_designs_of_longer_tables(spark, tmp_path):
    hours = [0] + [719] * 6 + [722] * 5 + [998] * 7 + [1000]
    spark.createDataFrame([(i, "view", h * 3600) for i, h in enumerate(hours)], "event_id long, event_type string, s long").withColumn("ts", F.timestamp_seconds("s")).write.parquet(str(tmp_path / "events.parquet"))
    run = lambda name: catalog.queries()[name](spark, str(tmp_path)).collect()
    impulses = {(h + k, k): n for h, n in ((719, 6), (722, 5), (998, 7)) for k in range(6) if h + k <= 1000}
    assert {(x.t, x.k): x.x for x in run("impulse_design")} == impulses
    reached = {h + k for h in (719, 722, 998) for k in range(12) if h + k <= 1000}
    assert {x.t for x in run("dog_design")} == reached
    assert {(x.order, x.t) for x in run("laguerre_design")} == {(o, t) for o in range(3) for t in reached}


def test_bootstrap_of_all_rows(spark):
    w = statistics.poisson_weights(np.arange(-20_000, 20_000), 10)
    for k in range(5):
        assert abs((w == k).mean() - math.exp(-1) / math.factorial(k)) < 0.005
    assert abs(np.corrcoef(w.T) - np.eye(10)).max() < 0.03
    r = np.random.default_rng(8)
    values = [(i, i % 3, float(v)) for i, v in enumerate(r.normal(50, 10, 6000))]
    extra = [(6000, 3, 7.0), (6001, None, 1.0), (6002, 0, None)]
    rows = spark.createDataFrame(values + extra, "id long, b int, v double").withColumn("h", F.xxhash64("id"))
    keys = {x.id: x.h for x in rows.collect()}
    got = {x.b: x for x in statistics.bootstrap_means(rows.repartition(5), ["id"], "b", "v").collect()}
    assert set(got) == {0, 1, 2, 3} and (got[3].lower, got[3].upper, got[3].n) == (7.0, 7.0, 1) and 40 <= got[3].draws <= 85
    for b in range(3):
        own = [(keys[i], v) for i, c, v in values if c == b]
        v, w = np.array([x for _, x in own]), statistics.poisson_weights(np.array([h for h, _ in own]), 100)
        means = (w * v[:, None]).sum(axis=0) / w.sum(axis=0)
        assert got[b].n == 2000 and got[b].draws == 100 and abs(got[b].mean - v.mean()) < 1e-9
        assert np.allclose([got[b].lower, got[b].upper], np.percentile(means, [2.5, 97.5]))
        assert 0.7 < (got[b].upper - got[b].lower) / (2 * 1.96 * v.std() / len(v) ** 0.5) < 1.3


def test_unbiased_crosscorrelation(spark, tmp_path):
    r = random.Random(3)
    busy = {b: {(d, h) for d in range(4) for h in range(24) if r.random() < 0.3} | {(0, 0), (3, 23)} for b in ("view", "click")}
    rows = [(b, (d * 24 + h) * 3600) for b, at in busy.items() for d, h in at for _ in range(5)]
    spark.createDataFrame(rows, "event_type string, s long").withColumn("ts", F.timestamp_seconds("s")).write.parquet(str(tmp_path / "events.parquet"))
    got = {x.lag: (x.r, x.trials) for x in catalog.queries()["xcorr_unbiased"](spark, str(tmp_path)).collect()}
    assert set(got) == set(range(-12, 13))
    for lag, (value, trials) in got.items():
        each = [sum((d, h) in busy["view"] and (d, h + lag) in busy["click"] for h in range(24)) / (24 - abs(lag)) for d in range(4)]
        assert trials == 4 and abs(value - sum(each) / 4) < 1e-6
    factor = spark.range(1).select(statistics.coherence_single(F.lit(0.4), 6).alias("x")).first().x
    assert math.isclose(factor, spectral.coherence_full(0.4, 6))
