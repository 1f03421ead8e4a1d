"""Scanned filters against a sample loop."""

import numpy as np
import pytest

from evokit.operators import filters


def loop(x, sections):
    y = np.array(x, float)
    for b0, b1, b2, a0, a1, a2 in sections:
        x1 = x2 = y1 = y2 = 0.0
        out = np.empty(len(y))
        for i, v in enumerate(y):
            out[i] = (b0 * v + b1 * x1 + b2 * x2 - a1 * y1 - a2 * y2) / a0
            x1, x2, y1, y2 = v, x1, out[i], y1
        y = out
    return y


def gain(sections, f, rate):
    z = np.exp(-2j * np.pi * np.asarray(f)[:, None] / rate * np.arange(3))
    return np.prod([abs((z @ s[:3]) / (z @ s[3:])) for s in sections], axis=0)


def test_designs():
    for order in (1, 2, 5, 10):
        band = filters.butterworth(order, 2048.0, 1.0 if order < 10 else 30.0, 50.0 if order < 10 else 200.0)
        low, high = (1.0, 50.0) if order < 10 else (30.0, 200.0)
        assert np.allclose(gain(band, [low, high], 2048.0), np.sqrt(0.5)) and len(band) == order
        for kind, edge in (({"low": 50.0}, 50.0), ({"high": 50.0}, 50.0)):
            s = filters.butterworth(order, 2048.0, **kind)
            f = np.array([edge, 10.0, 400.0])
            ratio = np.tan(np.pi * f / 2048) / np.tan(np.pi * edge / 2048)
            expected = 1 / np.sqrt(1 + ratio ** (2 * order if "high" in kind else -2 * order))
            assert np.allclose(gain(s, f, 2048.0), expected)
        for s in band:
            assert max(abs(np.roots(s[3:]))) < 1
    s = filters.notch_section(60.0, 2048.0)
    assert gain(s, [60.0], 2048.0) < 1e-9 and np.allclose(gain(s, [61.0, 59.0], 2048.0), np.sqrt(0.5), atol=0.02) and np.allclose(gain(s, [0.0, 1024.0], 2048.0), 1)
    for bad in ({}, {"low": 0.0}, {"high": 1024.0}, {"low": 5.0, "high": 5.0}, {"low": 6.0, "high": 5.0}):
        with pytest.raises(ValueError):
            filters.butterworth(2, 2048.0, **bad)


@pytest.mark.parametrize("chunk", [64, 192, 1 << 16])
def test_scan_equals_the_loop(spark, chunk):
    r = np.random.default_rng(5)
    a, b = r.normal(size=1000), np.cumsum(r.normal(size=257))
    rows = [("a", i, float(v), "c") for i, v in enumerate(a)] + [("b", i, float(v), "c") for i, v in enumerate(b)]
    # Gaps, nulls, repeats and rows that take no part.
    gaps = np.where((np.arange(900) < 130) | (np.arange(900) >= 700), r.normal(size=900), 0)
    rows += [("g", i, float(v), "c") for i, v in enumerate(gaps) if i < 130 or i >= 700] + [("g", 5, 99.0, "c"), (None, 1, 1.0, "c"), ("a", None, 1.0, "c"), ("a", -3, 1.0, "c")]
    gaps[10] = gaps[11] = 0
    rows = [(k, i, None if k == "g" and i == 10 else float("nan") if k == "g" and i == 11 else v, c) for k, i, v, c in rows]
    d = spark.createDataFrame(rows, "k string, t long, v double, chunk string")
    gaps[5] = min(gaps[5], 99.0)
    for sections in (filters.notch_section(60.0, 2048.0), np.concatenate([filters.notch_section(f, 2048.0) for f in (60, 120, 180, 240, 300, 360)]), filters.butterworth(10, 2048.0, 30.0, 200.0)):
        got = {}
        for x in filters.filtered(d, "k", "t", "v", sections, chunk).collect():
            got[x.k, x.i] = x.value
        for k, x in (("a", a), ("b", b), ("g", gaps)):
            y = loop(x, sections)
            at = [i for i in range(len(x)) if k != "g" or i < 130 or i >= 700]
            assert np.allclose([got[k, i] for i in at], y[at], atol=1e-9 * max(abs(y)))
        assert len(got) == 1000 + 257 + 330
    assert filters.filtered(d.where("false"), "k", "t", "v", sections, chunk).count() == 0


def test_zero_phase_and_envelope(spark):
    r = np.random.default_rng(6)
    x = r.normal(size=700)
    d = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(x)], "k string, t long, v double")
    above, band = filters.butterworth(4, 100.0, low=20.0), filters.butterworth(2, 100.0, 1.0, 10.0)
    both = lambda v, s: loop(loop(v, s)[::-1], s)[::-1]
    got = np.array([v.value for v in filters.zero_phase(d, "k", "t", "v", above, 128).orderBy("i").collect()])
    high = both(x, above)
    assert np.allclose(got, high, atol=1e-9)
    got = np.array([v.value for v in filters.envelope(d, "k", "t", "v", above, band, 128).orderBy("i").collect()])
    assert np.allclose(got, both(abs(high - high.mean()), band), atol=1e-9)
    with pytest.raises(ValueError, match="multiple"):
        filters.filtered(d, "k", "t", "v", above, 100)
