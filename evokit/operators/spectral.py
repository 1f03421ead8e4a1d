"""Spectra and coherence.

Discrete Fourier sums over chunks of fixed length are relational (a join with a table of frequencies, sums that
combine before the shuffle). Windowed spectra deal each sample to the windows it is in, so a task holds windows, not series;
the index of a series counts 0, 1, 2... there. Resampling and the Fourier mask transform a whole channel, a group each; recursive filters are in ``filters``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def chunked(series: DataFrame, index: str, length: int) -> DataFrame:
    """Adds chunk and u, the place within the chunk."""
    return series.withColumn("chunk", F.floor(F.col(index) / length)).withColumn("u", F.pmod(F.col(index), F.lit(length)))


def fourier(cells: DataFrame, keys: list[str], place: str, value: str, length: int) -> DataFrame:
    """(keys..., f, re, im) for f = 0..length / 2: one explode by frequencies, one sum."""
    spread = cells.withColumn("f", F.explode(F.sequence(F.lit(0), F.lit(length // 2))))
    angle = F.lit(2 * math.pi / length) * F.col("f") * F.col(place)
    return spread.groupBy(*keys, "f").agg(F.sum(F.col(value) * F.cos(angle)).alias("re"), F.sum(-F.col(value) * F.sin(angle)).alias("im"))


def coherence(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """(f, coherence): |sum X Y*|^2 / (sum |X|^2 sum |Y|^2) over chunks."""
    j = left.alias("l").join(right.alias("r"), [*keys, "f"])
    lr, li, rr, ri = (F.col(c) for c in ("l.re", "l.im", "r.re", "r.im"))
    s = j.groupBy("f").agg(F.sum(lr * rr + li * ri).alias("a"), F.sum(li * rr - lr * ri).alias("b"), F.sum(lr * lr + li * li).alias("x"), F.sum(rr * rr + ri * ri).alias("y"))
    return s.select("f", ((F.col("a") * F.col("a") + F.col("b") * F.col("b")) / (F.col("x") * F.col("y"))).alias("coherence"))


def slepian_tapers(n: int, nw: float, k: int) -> np.ndarray:
    """The k first discrete prolate sequences, as eigenvectors of the tridiagonal matrix that commutes with the concentration."""
    w = nw / n
    i = np.arange(n)
    m = np.diag(((n - 1 - 2 * i) / 2) ** 2 * np.cos(2 * np.pi * w)) + np.diag(i[1:] * (n - i[1:]) / 2, 1) + np.diag(i[1:] * (n - i[1:]) / 2, -1)
    vec = np.linalg.eigh(m)[1][:, ::-1][:, :k].T
    for j in range(k):
        lead = vec[j].sum() if j % 2 == 0 else (n - 1 - 2 * i) @ vec[j]
        if lead < 0:
            vec[j] = -vec[j]
    return vec


def windows(series: DataFrame, key: str, index: str, values: list[str], window: int, step: int, pad: int = 0) -> DataFrame:
    """(key, win, u, values...): the samples of each window as arrays by u, the place in it. Window k starts ``k * step`` after ``pad`` places ahead of index 0."""
    at = F.col(index).cast("long") + pad
    own = F.sequence(F.greatest(F.lit(0), F.floor((at - window) / step) + 1), F.floor(at / step))
    spread = series.select(key, at.alias("at"), *values, F.explode(own).alias("win")).withColumn("u", F.col("at") - F.col("win") * step).where(F.col("u").between(0, window - 1))
    got = spread.groupBy(key, "win").agg(F.sort_array(F.collect_list(F.struct(F.col("u").cast("int").alias("u"), *(F.col(v).cast("double").alias(v) for v in values)))).alias("x"))
    return got.select(key, "win", *(F.col(f"x.{c}").alias(c) for c in ("u", *values)))


def multitaper_coherence(pairs: DataFrame, key: str, index: str, x: str, y: str, window: int, nw: float = 3.0) -> DataFrame:
    """(key, f, coherence, lower, upper) from half-overlapping windows and jackknifed tapers.

    Each leave-one-out estimate over windows (total less own) gives an arc-hyperbolic tangent of the coherency's modulus; the mean of
    the pseudo-values and two standard errors are carried back. A key with fewer than two windows gives no rows.
    """
    tapers = slepian_tapers(window, nw, int(2 * nw - 1))
    means = pairs.groupBy(key).agg(F.avg(x).alias("mean_x"), F.avg(y).alias("mean_y"))
    cut = windows(pairs, key, index, [x, y], window, window // 2).where(F.size("u") == window).join(means, key)

    def spectra(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in batches:
            if not len(g):
                continue
            fa, fb = (np.fft.rfft(tapers * (np.stack(g[c].to_numpy()) - g[m].to_numpy(float)[:, None])[:, None, :], axis=2) for c, m in ((x, "mean_x"), (y, "mean_y")))
            xy, xx, yy = (fa * fb.conj()).mean(1), (abs(fa) ** 2).mean(1), (abs(fb) ** 2).mean(1)
            yield pd.DataFrame({key: g[key], "re": list(xy.real), "im": list(xy.imag), "xx": list(xx), "yy": list(yy)})

    kind = pairs.schema[key].dataType.simpleString()
    return jackknifed_coherence(cut.select(key, x, y, "mean_x", "mean_y").mapInPandas(spectra, f"{key} {kind}, " + ", ".join(f"{c} array<double>" for c in CROSS)), [key])


CROSS = ("re", "im", "xx", "yy")


def jackknifed_coherence(lists: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., f, coherence, lower, upper) from rows of windows: the cross spectrum and both powers by frequency, as arrays (re, im, xx, yy)."""
    names = CROSS
    own = lists.select(*keys, F.posexplode(F.arrays_zip(*names)).alias("f", "parts_")).select(*keys, "f", "parts_.*")
    total = own.groupBy(*keys, "f").agg(F.count("*").alias("n"), *(F.sum(c).alias(f"all_{c}") for c in names)).where("n > 1")

    def z(re: Column, im: Column, xx: Column, yy: Column) -> Column:
        return F.atanh(F.least(F.sqrt(re * re + im * im) / F.sqrt(F.greatest(xx * yy, F.lit(1e-300))), F.lit(1 - 1e-12)))

    n = F.col("n")
    pseudo = n * z(*(F.col(f"all_{c}") for c in names)) - (n - 1) * z(*(F.col(f"all_{c}") - F.col(c) for c in names))
    by = own.join(total, [*keys, "f"]).groupBy(*keys, "f").agg(F.avg(pseudo).alias("mean"), (F.stddev_samp(pseudo) / F.sqrt(F.max("n"))).alias("error"))
    back = lambda v: F.pow(F.tanh(F.greatest(v, F.lit(0.0))), 2)
    mean, error = F.col("mean"), F.col("error")
    return by.select(*keys, "f", back(mean).alias("coherence"), back(mean - 2 * error).alias("lower"), back(mean + 2 * error).alias("upper"))


def gaussian_spectrogram(clips: DataFrame, key: str, index: str, value: str, window: int, hop: int, deviations: float = 6.0) -> DataFrame:
    """(key, frame, f, power_db): a Gaussian-windowed short-time spectrum of each clip, with zeros about it, in decibels."""
    centre = (np.arange(window) - (window - 1) / 2) / (window / deviations)
    shape = np.exp(-0.5 * centre**2)
    pad = window // 2
    ends = clips.groupBy(key).agg((F.max(index).cast("long") + (1 + 2 * pad - window)).alias("last"))
    cut = windows(clips, key, index, [value], window, hop, pad).join(ends, key).where(F.col("win") * hop <= F.col("last"))

    def spectra(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in batches:
            v = np.zeros((len(g), window))
            for to, u, x in zip(v, g["u"], g[value], strict=True):
                to[u] = x
            power = 20 * np.log10(np.maximum(abs(np.fft.rfft(shape * v, axis=1)), 1e-12))
            yield pd.DataFrame({key: g[key], "frame": g["win"], "p": list(power)})

    rows = cut.select(key, "win", "u", value).mapInPandas(spectra, f"{key} {clips.schema[key].dataType.simpleString()}, frame int, p array<double>")
    return rows.select(key, "frame", F.posexplode("p").alias("f", "power_db"))


def resampled(clips: DataFrame, key: str, index: str, value: str, rate: float) -> DataFrame:
    """(key, i, value): each clip resampled in the Fourier domain to round(n * rate) samples."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        v = g.sort_values(index)[value].to_numpy(float)
        n = round(len(v) * rate)
        out = np.fft.irfft(np.fft.rfft(v)[: n // 2 + 1], n) * (n / len(v)) if n else np.empty(0)
        return pd.DataFrame({key: g[key].iloc[0], "i": np.arange(n, dtype=np.int64), "value": out})

    return clips.select(key, index, value).groupBy(key).applyInPandas(run, f"{key} {clips.schema[key].dataType.simpleString()}, i long, value double")


def welch(clips: DataFrame, key: str, index: str, value: str, window: int) -> DataFrame:
    """(key, f, power): mean Hann-windowed periodogram over half-overlapping windows of each channel."""
    shape = np.hanning(window)

    def spectra(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in batches:
            if len(g):
                v = np.stack(g[value].to_numpy())
                power = abs(np.fft.rfft(shape * (v - v.mean(1, keepdims=True)), axis=1)) ** 2 / (shape @ shape)
                yield pd.DataFrame({key: g[key], "p": list(power)})

    whole = windows(clips, key, index, [value], window, window // 2).where(F.size("u") == window).select(key, value)
    rows = whole.mapInPandas(spectra, f"{key} {clips.schema[key].dataType.simpleString()}, p array<double>")
    return rows.select(key, F.posexplode("p").alias("f", "p")).groupBy(key, "f").agg(F.avg("p").alias("power"))


def bandpass(clips: DataFrame, key: str, index: str, value: str, low: float, high: float, rate: float) -> DataFrame:
    """(key, i, value): the part of each channel between two frequencies, by a Fourier mask."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        v = g.sort_values(index)[value].to_numpy(float)
        s, f = np.fft.rfft(v), np.fft.rfftfreq(len(v), 1 / rate)
        s[(f < low) | (f > high)] = 0
        return pd.DataFrame({key: g[key].iloc[0], "i": np.arange(len(v), dtype=np.int64), "value": np.fft.irfft(s, len(v))})

    return clips.select(key, index, value).groupBy(key).applyInPandas(run, f"{key} {clips.schema[key].dataType.simpleString()}, i long, value double")


def coherence_full(c12: float, m: int) -> float:
    """What coherence with a mean of ``m`` trials gains over that with one trial, from the halves' coherence."""
    root = math.sqrt(1 / c12)
    return (1 + root) / (-m + m * root + 2)


def snr_spectrum(halves: DataFrame, key: str, index: str, a: str, b: str, trials: str, rate: float, window: int) -> DataFrame:
    """(f, snr, bits, total): the ratio of signal to noise of a single trial by frequency, over all keys, the information in it and its running total.

    ``a`` and ``b`` are the summed responses of the even and odd half of ``trials`` trials over a key's samples 0, 1, 2... A key's coherence of the halves, over half-overlapping
    Hann windows, is taken to be 0 unless it is two deviations over the mean of the frequencies from a quarter of ``rate`` up, which is taken off; it parts
    the power of all trials into signal and noise, which are added up over keys by samples and trials. The ratio of the sums is cleaned in the same way. Keys whose
    halves do not vary, and those shorter than a window, are left out; no noise is added to keep 0 / 0 away, it counts as 0.
    """
    shape = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(window) / window)
    scale = np.full(window // 2 + 1, 2.0) / (rate * (shape @ shape))
    scale[0] /= 2
    if window % 2 == 0:
        scale[-1] /= 2
    sizes = halves.groupBy(key).agg(F.count("*").alias("samples"), F.max(trials).alias("k"), F.var_pop(a).alias("va"), F.var_pop(b).alias("vb")).where("va > 0 and vb > 0")
    cut = windows(halves, key, index, [a, b], window, window // 2).where(F.size("u") == window)

    def spectra(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in batches:
            if len(g):
                x, y = (np.stack(g[c].to_numpy()) for c in (a, b))
                fx, fy = (np.fft.rfft(shape * (v - v.mean(1, keepdims=True)), axis=1) for v in (x, y))
                xy = fx * fy.conj()
                yield pd.DataFrame({key: g[key], "re": list(xy.real), "im": list(xy.imag), "xx": list(abs(fx) ** 2), "yy": list(abs(fy) ** 2), "p": list(scale * abs(fx + fy) ** 2)})

    names = ("re", "im", "xx", "yy", "p")
    kind = halves.schema[key].dataType.simpleString()
    lists = cut.select(key, a, b).mapInPandas(spectra, f"{key} {kind}, " + ", ".join(f"{c} array<double>" for c in names))
    means = lists.select(key, F.posexplode(F.arrays_zip(*names)).alias("f", "parts_")).groupBy(key, "f").agg(*(F.avg(f"parts_.{c}").alias(c) for c in names))
    both = F.col("xx") * F.col("yy")
    c = F.when(both > 0, (F.col("re") * F.col("re") + F.col("im") * F.col("im")) / both).otherwise(0.0)
    fast = F.col("f") * (rate / window) >= rate / 4

    def cleaned(df: DataFrame, value: str, bias: DataFrame, on: list[str]) -> DataFrame:
        df = df.join(bias, on) if on else df.crossJoin(F.broadcast(bias))  # one row
        less = F.col(value) - F.col("mean")
        return df.withColumn(value, F.when(less < 2 * F.col("sd"), 0.0).otherwise(less)).drop("mean", "sd")

    rows = means.select(key, "f", c.alias("c"), "p")
    rows = cleaned(rows, "c", rows.where(fast).groupBy(key).agg(F.avg("c").alias("mean"), F.stddev_pop("c").alias("sd")), [key]).join(sizes, key)
    root = F.least(F.sqrt("c"), F.lit(1 - 1e-9))
    snr = 2 * root / (1 - root) / F.col("k")
    power, noise = F.col("p") / (F.col("k") * F.col("k")), F.col("p") / (F.col("k") * F.col("k")) / (1 + snr)
    data = F.col("samples") * F.col("k")
    sums = rows.groupBy("f").agg(F.sum((power - noise) * data).alias("s"), F.sum(noise * data).alias("n"))
    whole = sums.select("f", F.when(F.col("s") + F.col("n") > 0, F.col("s") / (F.col("s") + F.col("n"))).otherwise(0.0).alias("c"))
    whole = cleaned(whole, "c", whole.where(fast).agg(F.avg("c").alias("mean"), F.stddev_pop("c").alias("sd")), [])
    ratio = F.col("c") / (1 - F.col("c"))
    out = whole.select("f", ratio.alias("snr"), (F.log2(1 + ratio) * (rate / window)).alias("bits"))
    return out.withColumn("total", F.sum("bits").over(Window.orderBy("f")))  # half a window's rows
