"""Queries on hourly counts as signals: event types are bands."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evokit.catalog import query
from evokit.operators import filters, sequences, spectral, statistics
from evokit.plans.events import HOUR, HOURLY_SQL, hourly, micros
from evokit.session import table

HANN = sequences.hann(7)
_KERNEL = ", ".join(f"({k}, {h!r}::DOUBLE)" for k, h in enumerate(HANN))


def _smooth_sql(shift: int) -> str:
    return f"""WITH {HOURLY_SQL}, k(k, h) AS (VALUES {_KERNEL})
SELECT a.band, a.t, round(sum(h * coalesce(b.n, 0)), 6) AS smooth FROM hourly a, k LEFT JOIN hourly b ON b.band = a.band AND b.t = a.t + 3 - k + {shift} GROUP BY 1, 2"""


@query(_smooth_sql(0))
def smooth_hann_same(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.smooth(hourly(spark, sf_dir), "band", "t", "n", HANN).select("band", "t", F.round("smooth", 6).alias("smooth"))


@query(_smooth_sql(1))
def smooth_hann_shifted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.smooth(hourly(spark, sf_dir), "band", "t", "n", HANN, 1).select("band", "t", F.round("smooth", 6).alias("smooth"))


@query(f"""WITH {HOURLY_SQL}, m AS (SELECT band, sum(n)::DOUBLE / count(*) AS g FROM hourly GROUP BY 1),
p AS (SELECT a.band AS b1, b.band AS b2, l.i::INT AS lag, sum(a.n * b.n)::DOUBLE AS xy, sum(a.n)::DOUBLE AS x, sum(b.n)::DOUBLE AS y, count(*) AS n FROM hourly a, range(-6, 7) l(i) JOIN hourly b ON b.t = a.t + l.i WHERE a.band <= b.band GROUP BY ALL)
SELECT b1, b2, lag, round(xy - mb.g * x - ma.g * y + n * ma.g * mb.g, 4) AS s, n FROM p JOIN m ma ON ma.band = b1 JOIN m mb ON mb.band = b2""")
def autocorr_lags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lagged products of demeaned bands, upper triangle, with their overlaps. Counts are summed as whole numbers and centred once, so no order of adding matters."""
    cells = hourly(spark, sf_dir)
    left = cells.withColumn("lag", F.explode(F.sequence(F.lit(-6), F.lit(6)))).select(F.col("band").alias("b1"), "lag", F.col("n").alias("p"), (F.col("t") + F.col("lag")).alias("t"))
    pairs = left.join(cells.select(F.col("band").alias("b2"), "t", F.col("n").alias("q")), "t").where("b1 <= b2")
    sums = pairs.groupBy("b1", "b2", "lag").agg(F.sum(F.col("p") * F.col("q")).cast("double").alias("xy"), F.sum("p").cast("double").alias("x"), F.sum("q").cast("double").alias("y"), F.count("*").alias("n"))
    means = cells.groupBy("band").agg((F.sum("n").cast("double") / F.count("*")).alias("g"))
    both = sums.join(means.toDF("b1", "ga"), "b1").join(means.toDF("b2", "gb"), "b2")
    s = F.col("xy") - F.col("gb") * F.col("x") - F.col("ga") * F.col("y") + F.col("n") * F.col("ga") * F.col("gb")
    return both.select("b1", "b2", "lag", F.round(s, 4).alias("s"), "n")


def _centred(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = hourly(spark, sf_dir)
    return cells.join(cells.groupBy("band").agg(F.avg("n").alias("g")), "band").select("band", "t", (F.col("n") - F.col("g")).alias("v"))


_LOO = f"""WITH {HOURLY_SQL}, m AS (SELECT band, avg(n) AS g FROM hourly GROUP BY 1), c AS (SELECT band, t, t // 144 AS s, n - g AS v FROM hourly JOIN m USING (band)),
p AS (SELECT x.s AS set_id, l.i::INT AS lag, sum(x.v * y.v) AS s, count(*) AS n FROM c x, range(-4, 5) l(i) JOIN c y ON y.t = x.t + l.i AND y.band = 'click' WHERE x.band = 'view' GROUP BY 1, 2)
SELECT set_id, lag, round(s / n, 6) AS own, round((sum(s) OVER (PARTITION BY lag) - s) / (sum(n) OVER (PARTITION BY lag) - n), 6) AS rest FROM p"""


@query(_LOO)
def crosscorr_lags_loo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlation of views with clicks by lag in six-day sets, and with each set left out (total less own)."""
    cells = _centred(spark, sf_dir)
    x = cells.where("band = 'view'").withColumn("set_id", F.floor(F.col("t") / 144))
    pairs = x.withColumn("lag", F.explode(F.sequence(F.lit(-4), F.lit(4)))).withColumn("at", F.col("t") + F.col("lag"))
    j = pairs.join(cells.where("band = 'click'").select(F.col("t").alias("at"), F.col("v").alias("w")), "at")
    d = statistics.total_minus_own(j, ["set_id"], ["lag"], {"s": F.sum(F.col("v") * F.col("w")), "n": F.count("*")})
    return d.select("set_id", "lag", F.round(F.col("s") / F.col("n"), 6).alias("own"), F.round(F.col("rest_s") / F.col("rest_n"), 6).alias("rest"))


@query(f"""WITH {HOURLY_SQL}, d AS (SELECT band, t, n, lead(n) OVER (PARTITION BY band ORDER BY t) - n AS diff FROM hourly),
p AS (SELECT *, lag(n) OVER w AS a, lead(n) OVER w AS z FROM d WINDOW w AS (PARTITION BY band ORDER BY t))
SELECT band, t, n, diff FROM p WHERE a < n AND z < n AND n >= 3""")
def first_diff_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = sequences.first_difference(hourly(spark, sf_dir), "band", "t", "n")
    return sequences.local_maxima(d, "band", "t", "n", 3.0)


@query()
def pruned_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Peaks of the hourly counts at least six hours apart, the highest first."""
    return sequences.pruned_peaks(sequences.local_maxima(hourly(spark, sf_dir), "band", "t", "n", 2.0), "band", "t", "n", 6)


@query(f"""WITH {HOURLY_SQL} SELECT band, t, n, lag(n, 1) OVER w AS x_1, lag(n, 2) OVER w AS x_2, lag(n, 24) OVER w AS x_24 FROM hourly WINDOW w AS (PARTITION BY band ORDER BY t)""")
def delay_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.delay_embedding(hourly(spark, sf_dir), "band", "t", "n", (1, 2, 24))


def _busy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours with more than four events, with the number of frames of the table's whole span."""
    cells = hourly(spark, sf_dir)
    frames = cells.agg((F.max("t") + 1).alias("frames"))
    return cells.where("n > 4").withColumn("kind", F.lit("busy")).crossJoin(F.broadcast(frames))  # one row


@query(f"""WITH {HOURLY_SQL}, e AS (SELECT band, t, n FROM hourly WHERE n > 4)
SELECT band, e.t + k.i AS t, k.i::INT AS k, sum(n)::BIGINT AS x FROM e, range(6) k(i) WHERE e.t + k.i <= (SELECT z - a FROM hb) GROUP BY 1, 2, 3""")
def impulse_design(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.impulse_design(_busy(spark, sf_dir), "band", "kind", "t", F.col("n"), 6, F.col("frames")).drop("kind")


def _laguerre_sql(order: int, tau: float, alpha: float) -> str:
    terms = " + ".join(f"({(-1) ** i * math.gamma(order + alpha + 1) / (math.gamma(order - i + 1) * math.gamma(alpha + i + 1) * math.factorial(i))!r})::DOUBLE * pow(k / {tau!r}::DOUBLE, {i})" for i in range(order + 1))
    return f"SELECT {order} AS o, k, exp(-k / {tau!r}::DOUBLE) * pow(k / {tau!r}::DOUBLE, {alpha!r}::DOUBLE) * ({terms}) AS b FROM ks"


@query(f"""WITH {HOURLY_SQL}, ks AS (SELECT i::INT AS k FROM range(12) r(i)), basis AS ({" UNION ALL ".join(_laguerre_sql(o, 3.0, 2.0) for o in range(3))}),
e AS (SELECT band, t, n FROM hourly WHERE n > 4) SELECT band, o AS "order", e.t + k AS t, round(sum(n * b), 6) AS x FROM e, basis WHERE e.t + k <= (SELECT z - a FROM hb) GROUP BY 1, 2, 3""")
def laguerre_design(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Busy hours convolved with three Laguerre functions of twelve hours."""
    ks = spark.range(12).select(F.col("id").cast("int").alias("k"))
    basis = None
    for o in range(3):
        own = ks.select(F.lit(o).alias("order"), "k", sequences.laguerre(F.col("k"), o, 3.0, 2.0).alias("b"))
        basis = own if basis is None else basis.unionByName(own)
    return sequences.basis_features(_busy(spark, sf_dir), basis, "band", "kind", "t", "n", F.col("frames")).select("band", "order", "t", F.round("x", 6).alias("x"))


@query(f"""WITH {HOURLY_SQL}, basis AS (SELECT i::INT AS k, 1.0::DOUBLE * exp(-0.5 * pow((i - 2.0::DOUBLE) / 1.0, 2)) - 0.5::DOUBLE * exp(-0.5 * pow((i - 5.0::DOUBLE) / 2.0, 2)) AS b FROM range(12) r(i)),
e AS (SELECT band, t, n FROM hourly WHERE n > 4) SELECT band, e.t + k AS t, round(sum(n * b), 6) AS x FROM e, basis WHERE e.t + k <= (SELECT z - a FROM hb) GROUP BY 1, 2""")
def dog_design(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Busy hours convolved with a difference of Gaussians."""
    basis = spark.range(12).select(F.lit(0).alias("order"), F.col("id").cast("int").alias("k"), sequences.gaussians(F.col("id"), 2.0, 1.0, 1.0, 5.0, 2.0, 0.5).alias("b"))
    return sequences.basis_features(_busy(spark, sf_dir), basis, "band", "kind", "t", "n", F.col("frames")).select("band", "t", F.round("x", 6).alias("x"))


@query(f"""WITH {HOURLY_SQL}, k(d, w) AS (VALUES (0, 0.5::DOUBLE), (1, 0.3::DOUBLE), (3, 0.2::DOUBLE))
SELECT a.band, a.t, round(sum(w * coalesce(b.n, 0)), 6) AS pred FROM hourly a, k LEFT JOIN hourly b ON b.band = a.band AND b.t = a.t - d GROUP BY 1, 2""")
def lin_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prediction of a kernel of three lags."""
    kernel = spark.createDataFrame([(0, 0.5), (1, 0.3), (3, 0.2)], "d int, w double")
    return sequences.convolve(hourly(spark, sf_dir), kernel, "band", "t", "n").select("band", "t", F.round("pred", 6).alias("pred"))


_DFT = f"""{HOURLY_SQL}, c AS (SELECT band, t // 24 AS chunk, t % 24 AS u, n FROM hourly),
ft AS (SELECT band, chunk, f.i AS f, sum(n * cos(2 * pi() / 24 * f.i * u)) AS re, sum(-n * sin(2 * pi() / 24 * f.i * u)) AS im FROM c, range(13) f(i) GROUP BY 1, 2, 3)"""


def _ft(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spectral.fourier(spectral.chunked(hourly(spark, sf_dir), "t", 24), ["band", "chunk"], "u", "n", 24)


@query(f"WITH {_DFT} SELECT band, f::INT AS f, round(avg(re * re + im * im), 4) AS power FROM ft GROUP BY 1, 2")
def dft_power(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean periodogram of one-day chunks by band."""
    return _ft(spark, sf_dir).groupBy("band", "f").agg(F.round(F.avg(F.col("re") * F.col("re") + F.col("im") * F.col("im")), 4).alias("power"))


_COH = f"""{_DFT}, co AS (SELECT x.f, (pow(sum(x.re * y.re + x.im * y.im), 2) + pow(sum(x.im * y.re - x.re * y.im), 2)) / (sum(x.re * x.re + x.im * x.im) * sum(y.re * y.re + y.im * y.im)) AS c
FROM ft x JOIN ft y USING (chunk, f) WHERE x.band = 'view' AND y.band = 'click' GROUP BY 1)"""


def _coherence(spark: SparkSession, sf_dir: str) -> DataFrame:
    ft = _ft(spark, sf_dir)
    return spectral.coherence(ft.where("band = 'view'").drop("band"), ft.where("band = 'click'").drop("band"), ["chunk"])


@query(f"WITH {_COH} SELECT f::INT AS f, round(c, 6) AS coherence, round(1 / ((-4 + 4 * sqrt(1 / c)) / 2 + 1), 6) AS bound FROM co")
def coherence_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coherence of views and clicks over one-day chunks, and the bound for a mean of four trials."""
    c = F.col("coherence")
    return _coherence(spark, sf_dir).select("f", F.round(c, 6).alias("coherence"), F.round(statistics.coherence_bound(c, 4), 6).alias("bound"))


@query(f"""WITH {_COH}, hv AS (SELECT user_id % 2 AS half, epoch_us(ts) // 3600000000 AS h, count(*) AS n FROM events WHERE event_type = 'view' GROUP BY 1, 2),
hc2 AS (SELECT k.i AS half, (r.h - a) // 24 AS chunk, (r.h - a) % 24 AS u, coalesce(n, 0) AS n FROM hb, unnest(range(a, z + 1)) r(h), range(2) k(i) LEFT JOIN hv ON hv.half = k.i AND hv.h = r.h),
hf AS (SELECT half, chunk, f.i AS f, sum(n * cos(2 * pi() / 24 * f.i * u)) AS re, sum(-n * sin(2 * pi() / 24 * f.i * u)) AS im FROM hc2, range(13) f(i) GROUP BY 1, 2, 3),
h2 AS (SELECT l.f, (pow(sum(l.re * r.re + l.im * r.im), 2) + pow(sum(l.im * r.re - l.re * r.im), 2)) / (sum(l.re * l.re + l.im * l.im) * sum(r.re * r.re + r.im * r.im)) AS c12 FROM hf l JOIN hf r USING (chunk, f) WHERE l.half = 0 AND r.half = 1 GROUP BY 1)
SELECT f::INT AS f, round(c12, 6) AS halves, round(c * (1 + sqrt(1 / c12)) / (2 - 4 + 4 * sqrt(1 / c12)), 6) AS single FROM co JOIN h2 USING (f) WHERE f BETWEEN 1 AND 11""")
def coherence_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coherence of clicks with one trial of views: that with their mean, corrected by the coherence of the views of even and odd users, as four trials."""
    hours = hourly(spark, sf_dir).select("t").distinct()
    e = table(spark, sf_dir, "events")
    start = micros(e).agg(F.min(F.floor(F.col("t") / HOUR)).alias("a"))
    own = micros(e.where("event_type = 'view'")).crossJoin(F.broadcast(start)).select((F.col("user_id") % 2).alias("half"), (F.floor(F.col("t") / HOUR) - F.col("a")).alias("t"))  # one row
    grid = hours.withColumn("half", F.explode(F.array(F.lit(0), F.lit(1))))
    cells = grid.join(own.groupBy("half", "t").agg(F.count("*").alias("n")), ["half", "t"], "left").select("half", F.floor(F.col("t") / 24).alias("chunk"), (F.col("t") % 24).alias("u"), F.coalesce("n", F.lit(0)).alias("n"))
    ft = spectral.fourier(cells, ["half", "chunk"], "u", "n", 24)
    halves = spectral.coherence(ft.where("half = 0").drop("half"), ft.where("half = 1").drop("half"), ["chunk"]).withColumnRenamed("coherence", "c12")
    both = _coherence(spark, sf_dir).join(halves, "f").where("f between 1 and 11")
    return both.select("f", F.round("c12", 6).alias("halves"), F.round(F.col("coherence") * statistics.coherence_single(F.col("c12"), 4), 6).alias("single"))


@query(f"""WITH {HOURLY_SQL}, x AS (SELECT band, t // 24 AS trial, t % 24 AS u, (n > 4)::INT AS v FROM hourly),
p AS (SELECT a.trial, l.i AS lag, sum(a.v * b.v) / count(*) AS r FROM x a, range(-12, 13) l(i) JOIN x b ON b.trial = a.trial AND b.u = a.u + l.i AND b.band = 'click' WHERE a.band = 'view' GROUP BY 1, 2)
SELECT lag::INT AS lag, round(avg(r), 6) AS r, count(*) AS trials FROM p GROUP BY 1""")
def xcorr_unbiased(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean over days, as trials, of the products of busy hours of views and clicks by lag, over the number of hours that overlap."""
    x = hourly(spark, sf_dir).select("band", F.floor(F.col("t") / 24).alias("trial"), F.col("t"), (F.col("n") > 4).cast("int").alias("v"))
    x = x.withColumn("at_day", F.col("trial") * 48 + F.col("t") % 24)  # days stand further apart than a lag
    pairs = sequences.lag_products(x.where("band = 'view'"), x.where("band = 'click'"), "at_day", range(-12, 13), ["l.trial"], F.col("l.v") * F.col("r.v"))
    return pairs.groupBy("lag").agg(F.round(F.avg(F.col("s") / F.col("n")), 6).alias("r"), F.count("*").alias("trials"))


@query(f"WITH {_COH} SELECT f::INT AS f, round(-ln(1 - c) / ln(2), 6) AS bits, round(sum(-ln(1 - c) / ln(2)) OVER (ORDER BY f), 6) AS total FROM co WHERE f BETWEEN 1 AND 11")
def info_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Information by frequency and its running total; a dozen rows are ordered."""
    c = _coherence(spark, sf_dir).where("f between 1 and 11").withColumn("bits", -F.log1p(-F.col("coherence")) / F.lit(math.log(2)))
    return c.select("f", F.round("bits", 6).alias("bits"), F.round(F.sum("bits").over(Window.orderBy("f")), 6).alias("total"))


@query()
def coherence_mtm_jn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jackknifed multitaper coherence of each band with clicks."""
    cells = hourly(spark, sf_dir)
    clicks = cells.where("band = 'click'").select("t", F.col("n").alias("y"))
    pairs = cells.where("band <> 'click'").withColumnRenamed("n", "x").join(clicks, "t")
    return spectral.multitaper_coherence(pairs, "band", "t", "x", "y", 128)


@query(f"""WITH {HOURLY_SQL}, w AS (SELECT band, k.i AS win, t + 24 - 12 * k.i AS u, n FROM hourly, hb, unnest(range((z - a + 1) // 12 + 1)) k(i) WHERE t + 24 - 12 * k.i BETWEEN 0 AND 47),
d AS (SELECT band, win, u, n * exp(-0.5 * pow((u - 23.5) / 8, 2)) AS v FROM w)
SELECT band, win::INT AS frame, f.i::INT AS f, round(20 * log10(greatest(sqrt(pow(sum(v * cos(2 * pi() * f.i * u / 48)), 2) + pow(sum(v * sin(2 * pi() * f.i * u / 48)), 2)), 1e-12)), 4) AS power_db FROM d, range(25) f(i) GROUP BY 1, 2, 3""")
def spectrogram_gauss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly counts in Gaussian windows of two days, one every half day."""
    return spectral.gaussian_spectrogram(hourly(spark, sf_dir), "band", "t", "n", 48, 12).withColumn("power_db", F.round("power_db", 4))


@query(f"""WITH {HOURLY_SQL}, l AS (SELECT (z - a + 1)::BIGINT AS len, round_even((z - a + 1) * 0.25::DOUBLE, 0)::BIGINT AS m FROM hb), k AS (SELECT r.i AS k, CASE WHEN r.i = 0 OR 2 * r.i = m THEN 1 ELSE 2 END AS c FROM l, unnest(range(m // 2 + 1)) r(i)),
x AS (SELECT band, k, c, sum(n * cos(2 * pi() * ((k * t) % len) / len)) AS re, sum(-n * sin(2 * pi() * ((k * t) % len) / len)) AS im FROM hourly, k, l GROUP BY 1, 2, 3)
SELECT band, o.i AS i, round(sum(c * (re * cos(2 * pi() * ((k * o.i) % m) / m) - CASE WHEN c = 1 THEN 0 ELSE im * sin(2 * pi() * ((k * o.i) % m) / m) END)) / any_value(len), 6) + 0.0::DOUBLE AS value FROM x, l, unnest(range(m)) o(i) GROUP BY 1, 2""")
def resample_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly counts resampled to one sample in four hours."""
    return spectral.resampled(hourly(spark, sf_dir), "band", "t", "n", 0.25).withColumn("value", F.round("value", 6))


_BETA = math.tan(2 * math.pi / 24 / 10 / 2)
_NOTCH = (1 / (1 + _BETA), -2 / (1 + _BETA) * math.cos(2 * math.pi / 24), 2 / (1 + _BETA) - 1)


@query(f"""WITH RECURSIVE {HOURLY_SQL}, x AS (SELECT band, t, {_NOTCH[0]!r}::DOUBLE * (n + lag(n, 2, 0) OVER w) + {_NOTCH[1]!r}::DOUBLE * lag(n, 1, 0) OVER w AS x FROM hourly WINDOW w AS (PARTITION BY band ORDER BY t)),
y AS (SELECT band, t, x AS y, 0.0::DOUBLE AS y1 FROM x WHERE t = 0 UNION ALL SELECT y.band, x.t, x.x - {_NOTCH[1]!r}::DOUBLE * y.y - {_NOTCH[2]!r}::DOUBLE * y.y1, y.y FROM y JOIN x ON x.band = y.band AND x.t = y.t + 1)
SELECT band, t AS i, round(y, 6) + 0.0::DOUBLE AS value FROM y""")
def notch_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly counts without their daily cycle."""
    return filters.filtered(hourly(spark, sf_dir), "band", "t", "n", filters.notch_section(1.0, 24.0, 10.0)).withColumn("value", F.round("value", 6))


@query()
def notch_harmonics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly counts without their daily cycle and its harmonics up to the sixth."""
    sections = np.concatenate([filters.notch_section(float(k), 24.0, 10.0) for k in range(1, 7)])
    return filters.filtered(hourly(spark, sf_dir), "band", "t", "n", sections).withColumn("value", F.round("value", 6))


@query()
def bandpass_butter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly counts between one and six cycles a day by a band-pass of order ten, forwards and backwards."""
    return filters.zero_phase(hourly(spark, sf_dir), "band", "t", "n", filters.butterworth(10, 24.0, 1.0, 6.0)).withColumn("value", F.round("value", 6))


@query()
def envelope_fast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How large the changes of hourly counts over six cycles a day are, smoothed to between a tenth of a cycle and two."""
    above, band = filters.butterworth(10, 24.0, low=6.0), filters.butterworth(4, 24.0, 0.1, 2.0)
    return filters.envelope(hourly(spark, sf_dir), "band", "t", "n", above, band).withColumn("value", F.round("value", 6))


@query(f"""WITH {HOURLY_SQL}, x AS (SELECT a.t, a.n AS y, lag(a.n) OVER (ORDER BY a.t) AS y1, lag(b.n) OVER (ORDER BY a.t) AS x1 FROM hourly a JOIN hourly b USING (t) WHERE a.band = 'purchase' AND b.band = 'view'),
r AS (SELECT * FROM x WHERE y1 IS NOT NULL), c AS (SELECT count(*)::DOUBLE n, covar_pop(y, y1) cy1, covar_pop(y, x1) cyx, covar_pop(y1, x1) c1x, var_pop(y) vy, var_pop(y1) v1, var_pop(x1) vx FROM r),
e AS (SELECT n, vy - cy1 * cy1 / v1 AS r0, vy - (cy1 * cy1 * vx - 2 * cy1 * cyx * c1x + cyx * cyx * v1) / (v1 * vx - c1x * c1x) AS r1 FROM c)
SELECT round((r0 - r1) / (r1 / (n - 3)), 4) AS f, n::BIGINT AS n FROM e""")
def granger_f(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether views help to predict purchases one hour on: the F value of one lag, from second moments."""
    cells = hourly(spark, sf_dir)
    y, x = (cells.where(F.col("band") == b).select("t", F.col("n").alias(c)) for b, c in (("purchase", "y"), ("view", "x")))
    before = y.join(x, "t").select((F.col("t") + 1).alias("t"), F.col("y").alias("y1"), F.col("x").alias("x1"))
    m = y.join(before, "t").agg(F.count("*").alias("n"), *(F.covar_pop(a, b).alias(c) for a, b, c in (("y", "y1", "cy1"), ("y", "x1", "cyx"), ("y1", "x1", "c1x"))), *(F.var_pop(a).alias(c) for a, c in (("y", "vy"), ("y1", "v1"), ("x1", "vx"))))
    r0 = F.expr("vy - cy1 * cy1 / v1")
    r1 = F.expr("vy - (cy1 * cy1 * vx - 2 * cy1 * cyx * c1x + cyx * cyx * v1) / (v1 * vx - c1x * c1x)")
    return m.select(F.round((r0 - r1) / (r1 / (F.col("n") - 3)), 4).alias("f"), "n")


@query("""WITH x AS (SELECT vec_id, label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS d FROM embeddings),
b AS (SELECT vec_id, floor(ln(d) / (ln(64) / 6))::INT AS bin, avg(v::DOUBLE) AS m FROM x GROUP BY 1, 2) SELECT vec_id, bin, round(m, 6) AS m FROM b""")
def log_bin_spec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embedding dimensions as frequencies, averaged in log-spaced bins."""
    x = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("p", "v")).withColumn("d", F.col("p") + 1)
    binned = x.withColumn("bin", F.floor(F.log("d") / (math.log(64) / 6)).cast("int"))
    return binned.groupBy("vec_id", "bin").agg(F.round(F.avg(F.col("v").cast("double")), 6).alias("m"))


@query()
def snr_by_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly counts of each type by users with even and odd ids, users being trials: the signal in one user's counts by frequency, and its bits."""
    e = micros(table(spark, sf_dir, "events")).select(F.col("event_type").alias("band"), "user_id", F.floor(F.col("t") / HOUR).alias("h"))
    first = e.agg(F.min("h").alias("a"))
    sides = e.crossJoin(F.broadcast(first)).groupBy("band", (F.col("h") - F.col("a")).alias("t")).agg(*(F.sum((F.col("user_id") % 2 == k).cast("double")).alias(c) for k, c in enumerate("xy")))  # one row
    users = e.groupBy("band").agg((F.floor(F.countDistinct("user_id") / 2) * 2).alias("trials"))
    cells = hourly(spark, sf_dir).select("band", "t").join(sides, ["band", "t"], "left").na.fill(0.0, ["x", "y"])
    smooth = [sequences.smooth(cells, "band", "t", c, HANN).select("band", "t", F.col("smooth").alias(c)) for c in "xy"]
    out = spectral.snr_spectrum(smooth[0].join(smooth[1], ["band", "t"]).join(users, "band"), "band", "t", "x", "y", "trials", 24.0, 64)
    return out.select("f", *(F.round(c, 6).alias(c) for c in ("snr", "bits", "total")))


@query()
def coherence_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each band's jackknifed multitaper coherence with clicks, from one cycle to eleven a day: its mean, and the information in it and in its bounds, in bits a day."""
    c = coherence_mtm_jn(spark, sf_dir).where((F.col("f") * 24 / 128 >= 1) & (F.col("f") * 24 / 128 < 11))
    bits = lambda v: F.round(-F.lit(24 / 128) * F.sum(F.log2(1 - F.least(F.col(v), F.lit(1 - 1e-12)))), 6)
    return c.groupBy("band").agg(F.round(F.avg("coherence"), 6).alias("coherence"), bits("coherence").alias("bits"), bits("lower").alias("bits_lower"), bits("upper").alias("bits_upper"))
