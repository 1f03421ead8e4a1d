"""Queries on trials of single units, generalised models and resampled fits."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evokit.catalog import query
from evokit.operators import glm, histograms, regression, spectral
from evokit.operators import statistics as st
from evokit.plans.events import _BASE, HOUR, HOURLY_SQL, aligned_spikes, hourly
from evokit.plans.models import LOO_SQL
from evokit.plans.statistics import FRAME_SQL, frame
from evokit.session import table


@query(f"""WITH {_BASE}, c AS (SELECT user_id, trial, CAST(round_even(o / 3600000000.0, 0) AS INT) AS bin, count(*)::BIGINT AS n FROM al GROUP BY 1, 2, 3), s AS (SELECT user_id, bin, sum(n) s, count(*) k FROM c GROUP BY 1, 2)
SELECT user_id, trial, bin, round(n - s::DOUBLE / k, 6) AS noise_own, round(CASE WHEN k > 1 THEN n - (s - n)::DOUBLE / (k - 1) END, 6) AS noise_others FROM c JOIN s USING (user_id, bin)""")
def trial_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of trials with spikes in a bin, less the mean of all such trials and of the other ones."""
    _, aligned = aligned_spikes(spark, sf_dir)
    cells = aligned.groupBy("user_id", "trial", histograms.bin_of(F.col("offset"), HOUR).alias("bin")).agg(F.count("*").alias("n"))
    return st.trial_noise(cells, ["user_id", "bin"], "n").select("user_id", "trial", "bin", F.round("noise_own", 6).alias("noise_own"), F.round("noise_others", 6).alias("noise_others"))


@query("""WITH o AS (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS i, round(o_totalprice * 100)::BIGINT AS v FROM orders),
u AS (SELECT o_custkey % 10 AS g, i, v FROM o) SELECT g, i::INT AS i, round(avg(v), 6) AS mean, count(*) AS n FROM u GROUP BY 1, 2""")
def ragged_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of each customer in time order as arrays of different lengths, averaged by place in ten groups."""
    o = table(spark, sf_dir, "orders").select("o_custkey", F.struct("o_orderdate", "o_orderkey", F.round(F.col("o_totalprice") * 100).cast("long").alias("v")).alias("x"))
    trains = o.groupBy("o_custkey").agg(F.sort_array(F.collect_list("x")).alias("x")).select((F.col("o_custkey") % 10).alias("g"), F.transform("x", lambda e: e["v"]).alias("v"))
    return st.ragged_average(trains, "g", "v").select("g", "i", F.round("mean", 6).alias("mean"), "n")


@query("SELECT round(avg(m), 4) AS mean_of_means FROM (SELECT user_id, avg(value) AS m FROM events GROUP BY 1)")
def resp_mean_of_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.mean_of_means(table(spark, sf_dir, "events"), "user_id", "value").select(F.round("mean_of_means", 4).alias("mean_of_means"))


@query(f"""WITH {FRAME_SQL} SELECT set_id, count(y) AS n, round(sum(y), 3) AS y, round(sum(y * y), 2) AS yy, round(sum(30 + 100 * x1), 3) AS p, round(sum((30 + 100 * x1) * (30 + 100 * x1)), 2) AS pp, round(sum(y * (30 + 100 * x1)), 2) AS yp FROM fr GROUP BY 1""")
def r2_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = st.r2_parts(F.col("y"), 30 + 100 * F.col("x1"))
    digits = {"n": None, "y": 3, "yy": 2, "p": 3, "pp": 2, "yp": 2}
    return frame(spark, sf_dir).groupBy("set_id").agg(*((c if digits[k] is None else F.round(c, digits[k])).alias(k) for k, c in parts.items()))


@query(f"""WITH {HOURLY_SQL}, w AS (SELECT band, t, array_agg(n) OVER (PARTITION BY band ORDER BY t ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS a FROM hourly)
SELECT band, t, list_sum(a)::BIGINT AS total, list_max(a) AS top FROM w WHERE len(a) = 4""")
def sliding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole windows of four hours from each hour on."""
    w = Window.partitionBy("band").orderBy("t").rowsBetween(0, 3)
    a = hourly(spark, sf_dir).select("band", "t", F.sum("n").over(w).alias("total"), F.max("n").over(w).alias("top"), F.count("*").over(w).alias("k"))
    return a.where("k = 4").drop("k")


def _lagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(t, y, x1, x2): purchases with views and clicks of the hour before."""
    cells = hourly(spark, sf_dir).where("band in ('purchase', 'view', 'click')").groupBy("t").pivot("band", ["purchase", "view", "click"]).agg(F.first("n"))
    ahead = cells.select((F.col("t") + 1).alias("t"), F.col("view").alias("x1"), F.col("click").alias("x2"))
    return cells.select("t", F.col("purchase").cast("double").alias("y")).join(ahead, "t")


@contextlib.contextmanager
def kept(rows: DataFrame) -> Iterator[DataFrame]:
    """Rows held on the executors while a fit passes over them."""
    rows = rows.persist()
    try:
        yield rows
    finally:
        rows.unpersist()


def _rows(spark: SparkSession, weights: np.ndarray, errors: list[float]) -> DataFrame:
    return spark.createDataFrame([(k, float(w), float(errors[-1]), len(errors)) for k, w in enumerate(weights)], "term int, weight double, error double, rounds int")


@query()
def glm_poisson(spark: SparkSession, sf_dir: str) -> DataFrame:
    with kept(_lagged(spark, sf_dir)) as rows:
        return _rows(spark, *glm.newton(rows, ["x1", "x2"], "y", "poisson"))


@query()
def glm_logistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    with kept(_lagged(spark, sf_dir).withColumn("hit", (F.col("y") > 2).cast("double"))) as rows:
        return _rows(spark, *glm.newton(rows, ["x1", "x2"], "hit", "logistic"))


@query()
def grad_line_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    with kept(_lagged(spark, sf_dir).select("y", (F.col("x1") / 10).alias("x1"), (F.col("x2") / 10).alias("x2"))) as rows:
        return _rows(spark, *glm.line_search_descent(rows, ["x1", "x2"], "y", "poisson", 30, 1e-9))


@query()
def scaled_conj_grad(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases from the two hours before by scaled conjugate gradients on standardised counts, with Poisson errors; a round is one pass."""
    scales = _lagged(spark, sf_dir).agg(*(f(c).alias(f"{n}_{c}") for c in ("x1", "x2") for n, f in (("mean", F.avg), ("sd", F.stddev_pop)))).first()
    z = [((F.col(c) - scales[f"mean_{c}"]) / (scales[f"sd_{c}"] or 1.0)).alias(c) for c in ("x1", "x2")]
    with kept(_lagged(spark, sf_dir).select("y", *z)) as rows:
        weights, errors = glm.scaled_conjugate_gradient(rows, ["x1", "x2"], "y", "poisson", 60, 1e-7)
    own = [float(w) / (scales[f"sd_{c}"] or 1.0) for w, c in zip(weights, ("x1", "x2"), strict=False)]
    own.append(float(weights[-1]) - sum(w * scales[f"mean_{c}"] for w, c in zip(own, ("x1", "x2"), strict=True)))
    return spark.createDataFrame([(k, round(w, 6), round(errors[-1], 9)) for k, w in enumerate(own)], "term int, weight double, error double")



@query(f"""WITH {HOURLY_SQL}, w AS (SELECT band, k.i AS win, t - 24 * k.i AS u, n, 0.5 - 0.5 * cos(2 * pi() * (t - 24 * k.i) / 47) AS h FROM hourly, hb, unnest(range((z - a + 1) // 24)) k(i) WHERE t - 24 * k.i BETWEEN 0 AND 47 AND 24 * k.i + 48 <= z - a + 1),
d AS (SELECT band, win, u, h, (n - avg(n) OVER (PARTITION BY band, win)) * h AS v FROM w),
p AS (SELECT band, win, f.i AS f, pow(sum(v * cos(2 * pi() * f.i * u / 48)), 2) + pow(sum(v * sin(2 * pi() * f.i * u / 48)), 2) AS p, sum(h * h) AS hh FROM d, range(25) f(i) GROUP BY 1, 2, 3)
SELECT band, f::INT AS f, round(avg(p / hh), 6) + 0.0::DOUBLE AS power FROM p GROUP BY 1, 2""")
def psd_welch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spectra of hourly counts over half-overlapping windows of two days."""
    return spectral.welch(hourly(spark, sf_dir), "band", "t", "n", 48).withColumn("power", F.round("power", 6))


@query(f"""WITH {HOURLY_SQL}, l AS (SELECT (z - a + 1)::BIGINT AS len FROM hb), k AS (SELECT r.i AS k FROM l, unnest(range(len // 2 + 1)) r(i) WHERE r.i * 24.0::DOUBLE / len BETWEEN 0.5 AND 4.0),
x AS (SELECT band, k, sum(n * cos(2 * pi() * ((k * t) % len) / len)) AS re, sum(-n * sin(2 * pi() * ((k * t) % len) / len)) AS im FROM hourly, k, l GROUP BY 1, 2)
SELECT h.band, h.t AS i, round(sum(2 * (re * cos(2 * pi() * ((k * t) % len) / len) - im * sin(2 * pi() * ((k * t) % len) / len))) / any_value(len), 6) + 0.0::DOUBLE AS value FROM hourly h JOIN x USING (band), l GROUP BY 1, 2""")
def bandpass_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly counts between half a cycle and four cycles a day."""
    return spectral.bandpass(hourly(spark, sf_dir), "band", "t", "n", 0.5, 4.0, 24.0).withColumn("value", F.round("value", 6))


@query(f"""WITH {LOO_SQL}, o AS (SELECT (d*p-b*q)/(a*d-b*b) h1, (a*q-b*p)/(a*d-b*b) h2, m1, m2, my FROM c), v AS (SELECT 0 AS term, h1 AS v FROM o UNION ALL SELECT 1, h2 FROM o UNION ALL SELECT 2, my - m1*h1 - m2*h2 FROM o)
SELECT term, round(avg(v), 5) AS weight, round(stddev_pop(v) * sqrt(count(*) - 1), 5) AS sd FROM v GROUP BY 1""")
def model_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of models with a fold of sets left out (rotating), averaged, with their deviation: all from one pass of sums."""
    by = regression.moments(frame(spark, sf_dir), ["x1", "x2"], "y", "w", "set_id")
    whole = regression.total(by)
    fits = np.array([[*c, b] for c, b in (regression.ridge(whole - m, 0.0) for m in by.values())])
    return spark.createDataFrame([(k, round(float(fits[:, k].mean()), 5), round(float(fits[:, k].std() * np.sqrt(len(fits) - 1)), 5)) for k in range(fits.shape[1])], "term int, weight double, sd double")


@query(f"""WITH {_BASE}, b AS (SELECT user_id, CAST(round_even(o / 3600000000.0, 0) AS INT) AS bin, count(*) n FROM al GROUP BY 1, 2), k AS (SELECT user_id, count(*) AS trials FROM tr GROUP BY 1)
SELECT k.user_id, trials, coalesce(sum(n), 0)::BIGINT AS spikes, coalesce(max(n), 0)::BIGINT AS busiest, round(coalesce(sum(n), 0)::DOUBLE / trials, 6) AS per_trial FROM k LEFT JOIN b ON b.user_id = k.user_id GROUP BY 1, 2""")
def unit_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a unit: its trials, aligned spikes, fullest bin and spikes a trial."""
    trials, aligned = aligned_spikes(spark, sf_dir)
    bins = aligned.groupBy("user_id", histograms.bin_of(F.col("offset"), HOUR).alias("bin")).agg(F.count("*").alias("n"))
    sums = bins.groupBy("user_id").agg(F.sum("n").alias("spikes"), F.max("n").alias("busiest"))
    out = trials.groupBy("user_id").agg(F.count("*").alias("trials")).join(sums, "user_id", "left").na.fill(0, ["spikes", "busiest"])
    return out.withColumn("per_trial", F.round(F.col("spikes") / F.col("trials"), 6))
