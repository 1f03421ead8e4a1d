"""Weighted moments, delete-one statistics, correlation and ceilings: mergeable sums, combined before any shuffle."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def weighted_moments(x: Column, y: Column, w: Column) -> dict[str, Column]:
    """Aggregates for weighted means, covariance and correlation from six sums."""
    sw, sx, sy = F.sum(w), F.sum(w * x), F.sum(w * y)
    sxx, syy, sxy = F.sum(w * x * x), F.sum(w * y * y), F.sum(w * x * y)
    cov = sxy / sw - (sx / sw) * (sy / sw)
    vx, vy = sxx / sw - (sx / sw) * (sx / sw), syy / sw - (sy / sw) * (sy / sw)
    return {"mean_x": sx / sw, "mean_y": sy / sw, "cov_xy": cov, "corr_xy": cov / F.sqrt(vx * vy)}


def total_minus_own(rows: DataFrame, own: list[str], over: list[str], sums: dict[str, Column]) -> DataFrame:
    """Delete-one sums: for each ``own`` group, each sum over all other groups that agree in ``over``.

    Sums are made once a group; the totals are sums of those, so the cost does not grow with the groups' number.
    """
    per = rows.groupBy(*over, *own).agg(*(c.alias(k) for k, c in sums.items()))
    if not over:  # one row of totals goes to all groups, so they are not gathered in one task
        whole = per.agg(*(F.sum(k).alias(f"all_{k}") for k in sums))
        return per.crossJoin(F.broadcast(whole)).select(*own, *(F.col(k) for k in sums), *((F.col(f"all_{k}") - F.col(k)).alias(f"rest_{k}") for k in sums))
    # Totals are joined back, so what agrees in ``over`` meets in no one task; nulls agree with nulls.
    whole = per.groupBy(*(F.col(c).alias(f"over_{c}") for c in over)).agg(*(F.sum(k).alias(f"all_{k}") for k in sums))
    same = [F.col(c).eqNullSafe(F.col(f"over_{c}")) for c in over]
    return per.join(whole, same).select(*over, *own, *(F.col(k) for k in sums), *((F.col(f"all_{k}") - F.col(k)).alias(f"rest_{k}") for k in sums))


def z_scores(cells: DataFrame, channel: str, value: str, sample: bool = True) -> DataFrame:
    """Adds ``z``: by channel, with a deviation of zero taken as one."""
    sd = F.stddev_samp(value) if sample else F.stddev_pop(value)
    stats = cells.groupBy(channel).agg(F.avg(value).alias("mean"), sd.alias("sd"))
    sd_or_one = F.when(F.coalesce(F.col("sd"), F.lit(0.0)) == 0, 1.0).otherwise(F.col("sd"))
    return cells.join(stats, channel).withColumn("z", (F.col(value) - F.col("mean")) / sd_or_one).drop("mean", "sd")


def pooled_correlation(rows: DataFrame, x: str, y: str) -> DataFrame:
    """Correlation about the one mean of all x and y."""
    s = rows.agg(F.count("*").alias("n"), *(F.sum(e).alias(k) for k, e in {"x": F.col(x), "y": F.col(y), "xx": F.col(x) * F.col(x), "yy": F.col(y) * F.col(y), "xy": F.col(x) * F.col(y)}.items()))
    m = (F.col("x") + F.col("y")) / (2 * F.col("n"))
    centred = lambda ab, a, b: F.col(ab) - m * (F.col(a) + F.col(b)) + F.col("n") * m * m
    return s.select((centred("xy", "x", "y") / F.sqrt(centred("xx", "x", "x") * centred("yy", "y", "y"))).alias("corr"))


def r2(pred: Column, y: Column, w: Column) -> Column:
    """1 less the weighted squared error by the weighted variance, pooled over all rows."""
    sw = F.sum(w)
    return 1 - (F.sum(w * (pred - y) * (pred - y)) / sw) / (F.sum(w * y * y) / sw - (F.sum(w * y) / sw) * (F.sum(w * y) / sw))


def ceiling_of_halves(r: Column) -> Column:
    """Explained-variance ceiling of the mean of two halves that correlate with r: 1 / (1 + (1 / r^2 - 1) * 2)."""
    return 1 / (1 + 2 * (1 / (r * r) - 1))


def ceiling_of_snr(r: Column) -> Column:
    snr = 2 * r / (1 - r)
    return snr / (1 + snr)


def coherence_bound(c: Column, m: int) -> Column:
    """Coherence of a noiseless mean from that of halves of ``m`` trials."""
    k = (-m + m * F.sqrt(1 / c)) / 2
    return 1 / (k + 1)


def coherence_single(c: Column, m: int) -> Column:
    """What coherence with a mean of ``m`` trials becomes with one trial, as a factor, from that of halves."""
    root = F.sqrt(1 / c)
    return (1 + root) / (-m + m * root + 2)


def ragged_average(frames: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, i, mean, n): mean of arrays of different lengths, by place: each place counts the arrays that reach it."""
    cells = frames.select(key, F.posexplode(vector).alias("i", "v"))
    return cells.groupBy(key, "i").agg(F.avg("v").alias("mean"), F.count("v").alias("n"))


def trial_noise(cells: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Adds noise_own (value less the mean of all) and noise_others (less the mean of the others, null for a single one)."""
    s = cells.groupBy(*keys).agg(F.sum(value).alias("s_"), F.count(value).alias("n_"))
    j = cells.join(s, keys)
    others = F.when(F.col("n_") > 1, (F.col("s_") - F.col(value)) / (F.col("n_") - 1))
    return j.withColumn("noise_own", F.col(value) - F.col("s_") / F.col("n_")).withColumn("noise_others", F.col(value) - others).drop("s_", "n_")


def mean_of_means(rows: DataFrame, key: str, value: str) -> DataFrame:
    return rows.groupBy(key).agg(F.avg(value).alias("m")).agg(F.avg("m").alias("mean_of_means"))


def r2_parts(y: Column, pred: Column) -> dict[str, Column]:
    """Mergeable sums from which R2 and correlation follow."""
    return {"n": F.count(y), "y": F.sum(y), "yy": F.sum(y * y), "p": F.sum(pred), "pp": F.sum(pred * pred), "yp": F.sum(y * pred)}


def single_trial_snr(cells: DataFrame, key: str, trial: Column, place: Column, value: str, trials: str) -> DataFrame:
    """(key, r, k, snr): the correlation r of the sums of even and odd trials over places, among the first k (column ``trials``) of them, and the single-trial ratio of signal to noise.

    Keys whose halves do not vary are left out.
    """
    halves = cells.select(key, (trial % 2).alias("half"), place.alias("u"), trial.alias("trial"), F.col(value).alias("v"), F.col(trials).alias("k")).where("trial < k")
    sums = halves.groupBy(key, "u").agg(*(F.sum(F.when(F.col("half") == h, F.col("v")).otherwise(0)).cast("double").alias(f"h{h}") for h in (0, 1)), F.max("k").alias("k"))
    r = sums.groupBy(key).agg(F.corr("h0", "h1").alias("r"), F.max("k").alias("k"), F.var_pop("h0").alias("v0"), F.var_pop("h1").alias("v1")).where("v0 > 0 and v1 > 0")
    return r.select(key, "r", "k", (2 * F.col("r") / (1 - F.col("r")) / F.col("k")).alias("snr"))


def hashed_sample(rows: DataFrame, key: str, salt: str, k: int) -> DataFrame:
    """``k`` rows without replacement: the least by a hash of key and salt, found without sorting all rows."""
    return rows.orderBy(F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{salt}"))), key).limit(k)


def group_bootstrap(rows: DataFrame, group: str, key: str, draws: int, share: float) -> DataFrame:
    """``rows`` for each draw with ``test``, whether its group is among the ``share`` set apart in the draw, and ``w``, how often the draw takes the row.

    Groups are a list of their distinct values, ranked by a hash within each draw; row weights are Poisson of mean 1 by a hash of (key, draw),
    which is sampling with replacement on either side without a count of it.
    """
    hashed = lambda c: F.md5(F.concat(F.col(c).cast("string"), F.lit(":"), F.col("draw").cast("string")))
    drawn = F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw")
    groups = rows.select(group).distinct()
    apart = groups.agg(F.ceil(F.lit(share) * F.count("*")).alias("apart"))
    sides = groups.select(group, drawn).crossJoin(F.broadcast(apart))  # one row
    sides = sides.withColumn("test", F.row_number().over(Window.partitionBy("draw").orderBy(hashed(group), group)) <= F.col("apart")).drop("apart")
    p = F.conv(F.substring(hashed(key), 1, 13), 16, 10).cast("double") / float(1 << 52)
    w = sum(((p >= float(c)).cast("int") for c in _POISSON_CDF[1:]), (p >= float(_POISSON_CDF[0])).cast("int"))
    return rows.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).withColumn("w", w).join(sides, [group, "draw"])


def pair_covariances(frames: DataFrame, vector: str) -> DataFrame:
    """(d1, d2, cov, n): population covariance of each two channels, d1 <= d2 from 1, over the frames that have both.

    A batch gives its product matrices as rows of channel pairs, which Spark sums in the task before the shuffle.
    Channels that are null or NaN are left out; arrays may differ in length.
    """

    def products(batches):
        for pdf in batches:
            rows = [v for v in pdf["v"] if v is not None and len(v)]
            if not rows:
                continue
            x = np.full((len(rows), max(map(len, rows))), np.nan)
            for to, v in zip(x, rows):
                to[: len(v)] = np.asarray(v, float)
            has = (~np.isnan(x)).astype(float)
            x = np.nan_to_num(x, posinf=np.inf, neginf=-np.inf)
            n, s, p = has.T @ has, x.T @ has, x.T @ x
            i, j = np.triu_indices(len(n))
            yield pd.DataFrame({"d1": i + 1, "d2": j + 1, "n": n[i, j].astype(int), "a": s[i, j], "b": s[j, i], "p": p[i, j]})

    parts = frames.select(F.col(vector).cast("array<double>").alias("v")).mapInPandas(products, "d1 int, d2 int, n long, a double, b double, p double")
    s = parts.groupBy("d1", "d2").agg(*(F.sum(c).alias(c) for c in ("n", "a", "b", "p"))).where("n > 0")
    return s.select("d1", "d2", (F.col("p") / F.col("n") - F.col("a") / F.col("n") * (F.col("b") / F.col("n"))).alias("cov"), "n")


def near_products(frames: DataFrame, key: str, vector: str, locality: int) -> DataFrame:
    """(key, d1, d2, p): products of each two channels at most ``locality`` apart, d1 <= d2 from 1."""
    v = F.col(vector).cast("array<double>")
    near = lambda i: F.filter(F.sequence(i, i + locality), lambda j: j <= F.size(vector))
    pairs = F.transform(F.sequence(F.lit(1), F.size(vector)), lambda i: F.transform(near(i), lambda j: F.struct(i.alias("d1"), j.alias("d2"), (F.get(v, i - 1) * F.get(v, j - 1)).alias("p"))))
    return frames.where(F.size(vector) > 0).select(key, F.explode(F.flatten(pairs)).alias("x")).select(key, "x.*")


#: P(W <= k) of a Poisson variable of mean 1, k = 0..18; above, the chance is under a double's last digit.
_POISSON_CDF = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(19)])
#: Bins that a task sums before it hands them on.
_BINS_HELD = 2048


def poisson_weights(keys: np.ndarray, draws: int) -> np.ndarray:
    """(len(keys), draws): how often each draw takes a row, Poisson of mean 1, from the row's 64-bit hash and the draw."""
    x = keys.astype(np.int64).view(np.uint64)[:, None] + np.arange(1, draws + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    x = x ^ (x >> np.uint64(31))
    return np.searchsorted(_POISSON_CDF, (x >> np.uint64(11)) * 2.0**-53, side="right")


def bootstrap_means(rows: DataFrame, trial: list[str], bin_col: str, value: str, draws: int = 100, lower: float = 0.025, upper: float = 0.975) -> DataFrame:
    """(bin, mean, lower, upper, n, draws): percentiles of the bin's mean over resamples with replacement of all rows.

    Each draw takes each trial Poisson(1) times by a hash of (trial, draw), which is resampling with replacement without a
    count over all trials; rows of one trial are taken together. A task sums its rows by (bin, draw) before the shuffle.
    Rows with a null bin or value are left out; a draw that takes no row of a bin has no mean there, and ``draws`` counts the others.
    """
    kind = rows.schema[bin_col].dataType.simpleString()
    good = rows.where(F.col(bin_col).isNotNull() & F.col(value).isNotNull()).select(F.xxhash64(*trial).alias("h"), F.col(bin_col).alias("b"), F.col(value).cast("double").alias("v"))

    def sums(batches):
        held: dict[object, np.ndarray] = {}

        def out():
            b, s = list(held), np.array(list(held.values()))
            return pd.DataFrame({"b": np.repeat(np.array(b, dtype=object), draws + 1), "draw": np.tile(np.arange(draws + 1), len(b)), "w": s[:, 0].ravel(), "s": s[:, 1].ravel()})

        for pdf in batches:
            w = np.column_stack((np.ones(len(pdf)), poisson_weights(pdf["h"].to_numpy(), draws)))  # draw 0 is all rows as they are
            v = pdf["v"].to_numpy(float)[:, None]
            for b, at in pdf.groupby("b", sort=False).indices.items():
                part = np.stack((w[at].sum(axis=0), (w[at] * v[at]).sum(axis=0)))
                held[b] = held[b] + part if b in held else part
            if len(held) > _BINS_HELD:
                yield out()
                held = {}
        if held:
            yield out()

    parts = good.mapInPandas(sums, f"b {kind}, draw int, w double, s double")
    means = parts.groupBy("b", "draw").agg(F.sum("w").alias("w"), F.sum("s").alias("s")).where("w > 0").withColumn("m", F.col("s") / F.col("w"))
    drawn = F.when(F.col("draw") > 0, F.col("m"))
    whole = F.col("draw") == 0
    by = means.groupBy("b").agg(F.max(F.when(whole, F.col("m"))).alias("mean"), F.percentile(drawn, lower).alias("lower"), F.percentile(drawn, upper).alias("upper"), F.max(F.when(whole, F.col("w"))).cast("long").alias("n"), F.count(drawn).alias("draws"))
    return by.withColumnRenamed("b", bin_col)
