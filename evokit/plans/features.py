"""Queries on parametric kernels, priors and stimulus features."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evokit.catalog import query
from evokit.operators import designs, event_features, intervals, kernels, segmented, sequences
from evokit.operators import regression as rg
from evokit.plans.events import HOUR, HOURLY_SQL, hourly, micros
from evokit.session import table


def _evoked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(band, lag, m): mean counts of 30 hours from hours with events on."""
    frames = hourly(spark, sf_dir)
    cells = intervals.windows_at(frames.where("n > 0").select("band", "t"), frames, "band", "t", "n", 0, 30)
    return cells.groupBy("band", "lag").agg(F.avg("n").alias("m"))


@query()
def kernel_fit_lg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Laguerre term fitted to each band's evoked response."""
    return kernels.fitted(_evoked(spark, sf_dir), "band", "lag", "m", kernels.fit_laguerre, ["amp", "tau", "alpha"])


@query()
def kernel_fit_dg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A difference of Gaussians fitted to each band's evoked response."""
    return kernels.fitted(_evoked(spark, sf_dir), "band", "lag", "m", kernels.fit_gaussians, ["a1", "m1", "s1", "a2", "m2", "s2", "c"])


@query("""WITH g AS (SELECT x.i AS x, y.i AS y FROM range(8) x(i), range(8) y(i)), n AS (SELECT a.x * 8 + a.y AS i, b.x * 8 + b.y AS j FROM g a, g b WHERE abs(a.x - b.x) + abs(a.y - b.y) = 1)
SELECT i, j, -1.0::DOUBLE AS v FROM n UNION ALL SELECT i, i, count(*)::DOUBLE FROM n GROUP BY i""")
def smoothness_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kernels.smoothness_prior(spark, (8, 8))


@query()
def path_following(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as 8 by 8 images: smooth weights for odd labels, the prior's weight halved; labels 8 and 9 stop it."""
    rows = table(spark, sf_dir, "embeddings").withColumn("y", (F.col("label") % 2).cast("double"))
    by = rg.array_moments(rows, "embedding", "y", "label")
    held = [by[k] for k in by if k in (8, 9)]
    kept = [by[k] for k in by if k not in (8, 9)]
    if not held or not kept:
        raise ValueError("the path needs labels 8 or 9 to stop it and others to train on")
    path = kernels.prior_path(sum(kept[1:], kept[0]), sum(held[1:], held[0]), kernels.laplacian((8, 8)))
    return spark.createDataFrame([(k, lam, float(e), float(np.linalg.norm(h))) for k, (lam, e, h) in enumerate(path)], "step int, lam double, error double, norm double")


_PIXELS = "px AS (SELECT vec_id, r.i AS i, embedding[r.i + 1]::DOUBLE AS v, (r.i // 8 + 0.5::DOUBLE) / 8 - 0.5::DOUBLE AS x, (r.i % 8 + 0.5::DOUBLE) / 8 - 0.5::DOUBLE AS y FROM embeddings, range(64) r(i))"


def _energy_sql(angle: int, frequency: int) -> str:
    at = f"2 * pi() * {frequency} * (x * cos(pi() * {angle} / 4) + y * sin(pi() * {angle} / 4))"
    part = lambda f: f"pow(sum(v * exp(-0.5 * (x * x + y * y) / 0.09::DOUBLE) * {f}({at})), 2)"
    return f"round(sqrt({part('cos')} + {part('sin')}), 6) AS g_{angle}_{frequency - 1}"


@query(f"WITH {_PIXELS} SELECT vec_id, {', '.join(_energy_sql(k, f) for k in range(4) for f in (1, 2))} FROM px GROUP BY vec_id")
def gabor_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quadrature energies of the embeddings read as 8 by 8 images."""
    out = kernels.gabor_energy(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "embedding", 8, 4, (1.0, 2.0)).drop("embedding")
    return out.select("vec_id", *(F.round(c, 6).alias(c) for c in out.columns if c != "vec_id"))


@query(f"""WITH {_PIXELS} SELECT vec_id, k.i::INT AS k, round(pow(sum(v * cos(2 * pi() * (((px.i // 8) * (k.i // 8) + (px.i % 8) * (k.i % 8)) % 8) / 8)), 2) + pow(sum(v * sin(2 * pi() * (((px.i // 8) * (k.i // 8) + (px.i % 8) * (k.i % 8)) % 8) / 8)), 2), 6) AS power
FROM px, range(64) k(i) GROUP BY 1, 2""")
def modulation_power(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-dimensional modulation power of the embeddings read as 8 by 8 images, a row a frequency."""
    out = kernels.modulation_power(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "vec_id", "embedding", 8)
    return out.select("vec_id", F.posexplode("power").alias("k", "power")).withColumn("power", F.round("power", 6))


@query()
def poisson_thin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A minute of spikes a customer, at 2 to 6 a second."""
    units = table(spark, sf_dir, "customer").select("c_custkey")
    return kernels.poisson_times(units, "c_custkey", 6.0, 60.0, lambda t: 4 + 2 * F.sin(t), 7)


@query(f"""WITH {HOURLY_SQL}, m AS (SELECT band, avg(n) AS g FROM hourly GROUP BY 1), c AS (SELECT band, t, n - g AS v FROM hourly JOIN m USING (band)),
s AS (SELECT a.band AS b1, b.band AS b2, avg(a.v * b.v) AS space FROM c a JOIN c b USING (t) GROUP BY 1, 2), p AS (SELECT band, l.i::INT AS lag, (SELECT sum(x.v * y.v) FROM c x JOIN c y ON y.band = x.band AND y.t = x.t + l.i WHERE x.band = z.band) AS acf FROM (SELECT DISTINCT band FROM c) z, range(7) l(i)),
k AS (SELECT lag, sum(acf) AS acf FROM p GROUP BY 1) SELECT b1, b2, lag, round(space * acf / (SELECT acf FROM k WHERE lag = 0), 6) AS v FROM s, k""")
def autocorr_separable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlation of bands at no lag times the bands' common course over lags."""
    cells = hourly(spark, sf_dir)
    cells = cells.join(cells.groupBy("band").agg(F.avg("n").alias("g")), "band").select("band", "t", (F.col("n") - F.col("g")).alias("v"))
    space = sequences.lag_products(cells, cells, "t", range(0, 1), ["l.band", "r.band"], F.col("l.v") * F.col("r.v")).toDF("b1", "b2", "zero", "s", "n").select("b1", "b2", (F.col("s") / F.col("n")).alias("space"))
    both = sequences.lag_products(cells, cells, "t", range(0, 7), ["l.band", "r.band"], F.col("l.v") * F.col("r.v")).toDF("b1", "b2", "lag", "s", "n")
    course = both.where("b1 = b2").groupBy("lag").agg(F.sum("s").alias("acf"))
    first = course.where("lag = 0").select(F.col("acf").alias("first"))
    scaled = course.crossJoin(F.broadcast(first)).select("lag", (F.col("acf") / F.col("first")).alias("k"))  # one row
    return space.crossJoin(F.broadcast(scaled)).select("b1", "b2", "lag", F.round(F.col("space") * F.col("k"), 6).alias("v"))  # seven lags


@query()
def event_kernel_loo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases from kernels of six hours at hours with views and with clicks, cross-validated over six-day sets."""
    cells = hourly(spark, sf_dir)
    events = cells.where("n > 0 and band in ('view', 'click')").withColumn("kind", (F.col("band") == "click").cast("int")).withColumn("one", F.lit("all"))
    last = cells.agg(F.max("t")).first()[0] or 0
    design = sequences.impulse_design(events, "one", "kind", "t", F.lit(1.0), 6, int(last) + 1)
    design = design.select(F.floor(F.col("t") / 144).alias("s"), "t", (F.col("kind") * 6 + F.col("k")).alias("feature"), "x")
    response = cells.where("band = 'purchase'").select(F.floor(F.col("t") / 144).alias("s"), "t", F.col("n").alias("y"), F.lit(1.0).alias("w"))
    by = designs.sparse_moments(design, response, "s", "t", "feature", "x", "y", "w", 12)
    scores = {r["tol"]: float(r["r2cv"]) for r in rg.ridge_loo(by, [0.2, 0.1, 0.05, 0.01, 0.005, 0.001])}
    best = max(scores, key=lambda t: (scores[t], t))
    whole = rg.total(by)
    coef, _ = rg.ridge(whole, best * max(np.linalg.norm((whole - m).centred()[0]) for m in by.values()))
    return spark.createDataFrame([("view" if j < 6 else "click", j % 6, float(c), best, scores[best]) for j, c in enumerate(coef)], "kind string, k int, weight double, tol double, r2cv double")


def _event_design(cells: DataFrame, kinds: list[str], length: int) -> tuple[DataFrame, DataFrame]:
    """(s, t, feature, x) of kernels of ``length`` hours at hours with events of each kind, and (s, t, y, w) of purchases; sets of six days."""
    which = F.array_position(F.array(*(F.lit(k) for k in kinds)), F.col("band")) - 1
    events = cells.where((F.col("n") > 0) & F.col("band").isin(kinds)).select(which.cast("int").alias("kind"), F.col("t").alias("at"))
    spread = events.select("kind", F.explode(F.sequence(F.lit(0), F.lit(length - 1))).alias("k"), "at").withColumn("t", F.col("at") + F.col("k"))
    design = spread.select(F.floor(F.col("t") / 144).alias("s"), "t", (F.col("kind") * length + F.col("k")).alias("feature"), F.lit(1.0).alias("x"))
    return design, cells.where("band = 'purchase'").select(F.floor(F.col("t") / 144).alias("s"), "t", F.col("n").alias("y"), F.lit(1.0).alias("w"))


@query()
def fit_seg_loo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases from kernels of six hours at hours with views and with clicks, by near-diagonal inverses: the tolerance with the best R2 of rectified predictions of left-out sets, and all sets' kernels at it."""
    design, response = _event_design(hourly(spark, sf_dir), ["view", "click"], 6)
    got = segmented.fit(segmented.products(design, response, "s", "t", "feature", "x", "y", "w", 12), list(segmented.TOLERANCES))
    return spark.createDataFrame([("view" if j < 6 else "click", j % 6, round(float(h), 9), round(got.bias, 9), segmented.TOLERANCES[got.best], round(got.scores[got.best], 9)) for j, h in enumerate(got.weights)], "kind string, k int, weight double, bias double, tol double, r2cv double")


@query(f"""WITH {HOURLY_SQL}, x AS (SELECT p.t // 144 AS s, p.t, p.n::DOUBLE AS y, coalesce((a.n > 0)::INT, 0)::DOUBLE AS x0, coalesce((b.n > 0)::INT, 0)::DOUBLE AS x1 FROM hourly p LEFT JOIN hourly a ON a.band = 'view' AND a.t = p.t LEFT JOIN hourly b ON b.band = 'view' AND b.t = p.t - 1 WHERE p.band = 'purchase'),
m AS (SELECT s, count(*)::DOUBLE AS n, sum(x0) AS u, sum(x1) AS v, sum(y) AS z FROM x GROUP BY 1), g AS (SELECT sum(n) AS n, sum(u) AS u, sum(v) AS v, sum(z) AS z FROM m),
l AS (SELECT s, m.n, (g.u - m.u) / (g.n - m.n) AS m0, (g.v - m.v) / (g.n - m.n) AS m1, (g.z - m.z) / (g.n - m.n) AS my FROM m, g WHERE m.n < g.n),
c AS (SELECT s, sum((x0 - m0) * (x0 - m0)) AS a, sum((x0 - m0) * (x1 - m1)) AS b, sum((x1 - m1) * (x1 - m1)) AS d, sum((x0 - m0) * (y - my)) AS p, sum((x1 - m1) * (y - my)) AS q FROM x JOIN l USING (s) GROUP BY 1),
k AS (SELECT sum(a) AS a, sum(b) AS b, sum(d) AS d, sum(p) AS p, sum(q) AS q FROM c),
o AS (SELECT s, m0, m1, my, (k.a - c.a) / (g.n - l.n) AS a, (k.b - c.b) / (g.n - l.n) AS b, (k.d - c.d) / (g.n - l.n) AS d, (k.p - c.p) / (g.n - l.n) AS p, (k.q - c.q) / (g.n - l.n) AS q FROM c JOIN l USING (s), k, g),
r AS (SELECT t.tol, t.tol * (SELECT max(sqrt(a * a + 2 * b * b + d * d)) FROM o) AS e FROM (VALUES (0.2::DOUBLE), (0.05::DOUBLE), (0.001::DOUBLE)) t(tol)),
h AS (SELECT tol, s, m0, m1, my, ((d + e) * p - b * q) / ((a + e) * (d + e) - b * b) AS h0, ((a + e) * q - b * p) / ((a + e) * (d + e) - b * b) AS h1 FROM o, r)
SELECT tol, round(1 - sum(pow(greatest(my + h0 * (x0 - m0) + h1 * (x1 - m1), 0) - y, 2)) / count(*) / (sum(y * y) / count(*) - pow(sum(y) / count(*), 2)), 6) AS r2cv FROM x JOIN h USING (s) GROUP BY 1""")
def fit_seg_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases from a kernel of two hours at hours with views, by ridge: R2 of left-out sets for three tolerances."""
    design, response = _event_design(hourly(spark, sf_dir), ["view"], 2)
    tolerances = [0.2, 0.05, 0.001]
    got = segmented.fit(segmented.products(design, response, "s", "t", "feature", "x", "y", "w", 2), tolerances, "ridge")
    return spark.createDataFrame([(t, round(r, 6)) for t, r in zip(tolerances, got.scores, strict=True)], "tol double, r2cv double")


@query()
def fit_seg_staged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases from kernels of six hours at views and clicks, and what those leave from the counts of errors and signups of three hours."""
    cells = hourly(spark, sf_dir)
    design, response = _event_design(cells, ["view", "click"], 6)
    counts = cells.where("band in ('error', 'signup')").select((F.col("band") == "signup").cast("int").alias("kind"), "n", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("k"), "t").withColumn("t", F.col("t") + F.col("k"))
    more = counts.select(F.floor(F.col("t") / 144).alias("s"), "t", (12 + F.col("kind") * 3 + F.col("k")).alias("feature"), F.log1p("n").alias("x"))
    p = segmented.products(design.unionByName(more), response, "s", "t", "feature", "x", "y", "w", 18)
    tolerances = [0.6, 0.5, 0.4, 0.2, 0.15, 0.1, 0.08, 0.05, 0.01, 0.005, 1e-3]
    rows = [(stage, j, round(float(h), 9), round(f.bias, 9), tolerances[f.best], round(f.scores[f.best], 9)) for stage, f in enumerate(segmented.fit_staged(p, 12, tolerances), 1) for j, h in enumerate(f.weights)]
    return spark.createDataFrame(rows, "stage int, feature int, weight double, bias double, tol double, r2cv double")


def _event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(kind, t, window): six hours of log counts of all bands from each hour with purchases or signups on."""
    cells = hourly(spark, sf_dir)
    frames = cells.groupBy("t").agg(F.transform(F.array_sort(F.collect_list(F.struct("band", "n"))), lambda v: F.log1p(v["n"])).alias("x")).withColumn("one", F.lit(0))
    events = cells.where("n > 0 and band in ('purchase', 'signup')").select(F.lit(0).alias("one"), F.col("band").alias("kind"), "t")
    return event_features.event_windows(events, frames, "one", "t", "x", 6, cells.select("band").distinct().count()).drop("one")


@query()
def pca_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows at purchases and signups on their four largest components, in the block of their kind; values are rounded, zeros of other kinds left out."""
    out, _ = event_features.event_components(_event_windows(spark, sf_dir), "kind", ["purchase", "signup"], 4)
    return out.select("kind", "t", F.posexplode("features").alias("k", "v")).where("v <> 0").withColumn("v", F.round("v", 6))


@query()
def event_modulation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Modulation power of the same windows, at two temporal frequencies either way and two spectral ones, less the mean of all."""
    windows = _event_windows(spark, sf_dir)
    width = hourly(spark, sf_dir).select("band").distinct().count()
    return event_features.event_modulation(windows, ["kind", "t"], 6, width, 2, 1).withColumn("power", F.round("power", 6))


@query(f"""WITH {HOURLY_SQL}, iv AS (SELECT event_id, event_type AS band, (epoch_us(ts) // 3600000000 - (SELECT a FROM hb))::BIGINT AS t FROM events WHERE event_type IN ('signup', 'purchase'))
SELECT event_id, (h.t - greatest(iv.t - 5, 0))::INT AS u, h.n FROM iv JOIN hourly h ON h.band = iv.band AND h.t >= iv.t - 5 AND h.t < iv.t + 30""")
def slices_at_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly counts, stored as blocks of 24, cut from five hours before each signup and purchase to thirty after it."""
    cells = hourly(spark, sf_dir)
    e = micros(table(spark, sf_dir, "events"))
    first = e.agg(F.floor(F.min("t") / HOUR).alias("a"))
    at = e.where("event_type in ('signup', 'purchase')").crossJoin(F.broadcast(first)).select("event_id", F.col("event_type").alias("band"), (F.floor(F.col("t") / HOUR) - F.col("a")).alias("t"))  # one row
    spans = at.select("event_id", "band", (F.col("t") - 5).cast("double").alias("start"), (F.col("t") + 30).cast("double").alias("stop"))
    out = event_features.slices(spans, event_features.sample_blocks(cells, "band", "t", "n", 24), "band", "start", "stop", 1.0, 24)
    return out.select("event_id", F.posexplode("data").alias("u", "n"))


@query()
def movie_fourier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as a movie of 8 by 8 images by id: spectra of six frames about each, sizes by spatial and temporal frequency."""
    movie = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return event_features.movie_fourier(movie, "vec_id", "embedding", (8, 8), 6).withColumn("v", F.round("v", 5))
