"""Queries on fitted models: sums by Spark, small dense solves, results as rows."""

from __future__ import annotations

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evokit.catalog import query
from evokit.functions import scalars
from evokit.operators import direct_fit, sequences
from evokit.operators import regression as rg
from evokit.operators import statistics as st
from evokit.plans.events import HOURLY_SQL, hourly
from evokit.plans.statistics import FRAME_SQL, frame
from evokit.session import table

_M = f"""{FRAME_SQL}, m AS (SELECT sum(w) sw, sum(w*x1)/sum(w) m1, sum(w*x2)/sum(w) m2, sum(w*y)/sum(w) my, sum(w*x1*x1)/sum(w) s11, sum(w*x2*x2)/sum(w) s22, sum(w*x1*x2)/sum(w) s12, sum(w*x1*y)/sum(w) s1y, sum(w*x2*y)/sum(w) s2y FROM fr),
c AS (SELECT m1, m2, my, s11-m1*m1 AS a, s22-m2*m2 AS d, s12-m1*m2 AS b, s1y-m1*my AS p, s2y-m2*my AS q FROM m)"""


def _moments(spark: SparkSession, sf_dir: str, by_set: bool = False) -> dict:
    return rg.moments(frame(spark, sf_dir), ["x1", "x2"], "y", "w", "set_id" if by_set else None)


@query(f"WITH {_M} SELECT round((d*p - b*q)/(a*d - b*b), 5) AS h1, round((a*q - b*p)/(a*d - b*b), 5) AS h2, round(my - m1*(d*p - b*q)/(a*d - b*b) - m2*(a*q - b*p)/(a*d - b*b), 5) AS bias FROM c")
def ols_2var(spark: SparkSession, sf_dir: str) -> DataFrame:
    coef, bias = rg.ridge(_moments(spark, sf_dir)[None], 0.0)
    return spark.createDataFrame([(round(float(coef[0]), 5), round(float(coef[1]), 5), round(bias, 5))], "h1 double, h2 double, bias double")


_TOLS = [0.1, 0.01, 0.001, 0.0001]


@query(f"""WITH {_M}, l(lam) AS (VALUES {", ".join(f"({t}::DOUBLE)" for t in _TOLS)}) SELECT lam, round(((d+lam)*p - b*q)/((a+lam)*(d+lam) - b*b), 5) AS h1, round(((a+lam)*q - b*p)/((a+lam)*(d+lam) - b*b), 5) AS h2 FROM c, l""")
def ridge_2var_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One pass of sums serves every penalty."""
    m = _moments(spark, sf_dir)[None]
    return spark.createDataFrame([(t, *(round(float(v), 5) for v in rg.ridge(m, t)[0])) for t in _TOLS], "lam double, h1 double, h2 double")


LOO_SQL = f"""{FRAME_SQL}, s AS (SELECT set_id, sum(w) sw, sum(w*x1) s1, sum(w*x2) s2, sum(w*y) sy, sum(w*x1*x1) s11, sum(w*x2*x2) s22, sum(w*x1*x2) s12, sum(w*x1*y) s1y, sum(w*x2*y) s2y, sum(w*y*y) syy FROM fr GROUP BY 1),
t AS (SELECT sum(sw) sw, sum(s1) s1, sum(s2) s2, sum(sy) sy, sum(s11) s11, sum(s22) s22, sum(s12) s12, sum(s1y) s1y, sum(s2y) s2y, sum(syy) syy FROM s),
r AS (SELECT set_id, s.sw w, s.s1 e1, s.s2 e2, s.sy ey, s.s11 e11, s.s22 e22, s.s12 e12, s.s1y e1y, s.s2y e2y, s.syy eyy, t.sw-s.sw sw, t.s1-s.s1 s1, t.s2-s.s2 s2, t.sy-s.sy sy, t.s11-s.s11 s11, t.s22-s.s22 s22, t.s12-s.s12 s12, t.s1y-s.s1y s1y, t.s2y-s.s2y s2y FROM s, t),
c AS (SELECT *, s1/sw m1, s2/sw m2, sy/sw my, s11/sw-(s1/sw)*(s1/sw) a, s22/sw-(s2/sw)*(s2/sw) d, s12/sw-(s1/sw)*(s2/sw) b, s1y/sw-(s1/sw)*(sy/sw) p, s2y/sw-(s2/sw)*(sy/sw) q FROM r),
n AS (SELECT max(sqrt(a*a+d*d+2*b*b)) nm FROM c), l(tol) AS (VALUES {", ".join(f"({t}::DOUBLE)" for t in _TOLS)}),
h AS (SELECT c.*, tol, ((d+tol*nm)*p-b*q)/((a+tol*nm)*(d+tol*nm)-b*b) h1, ((a+tol*nm)*q-b*p)/((a+tol*nm)*(d+tol*nm)-b*b) h2 FROM c, n, l)"""


@query(f"""WITH {LOO_SQL},
e AS (SELECT tol, sum(h1*h1*e11 + h2*h2*e22 + (my-m1*h1-m2*h2)*(my-m1*h1-m2*h2)*w + eyy + 2*h1*h2*e12 + 2*h1*(my-m1*h1-m2*h2)*e1 + 2*h2*(my-m1*h1-m2*h2)*e2 - 2*h1*e1y - 2*h2*e2y - 2*(my-m1*h1-m2*h2)*ey) AS sse FROM h GROUP BY 1)
SELECT tol, round(1 - sse/t.sw/(t.syy/t.sw-(t.sy/t.sw)*(t.sy/t.sw)), 6) AS r2cv FROM e, t""")
def ridge_loo_r2cv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each set predicted by the others, all from one pass of sums."""
    rows = rg.ridge_loo(_moments(spark, sf_dir, True), _TOLS)
    return spark.createDataFrame([(r["tol"], round(float(r["r2cv"]), 6)) for r in rows], "tol double, r2cv double")


_GRID = f"""{LOO_SQL}, z AS (SELECT tol, stddev_pop(h1) * sqrt(count(*) - 1) z1, stddev_pop(h2) * sqrt(count(*) - 1) z2 FROM h GROUP BY 1), k(sparseness) AS (VALUES (0.0::DOUBLE), (1.0::DOUBLE), (2.0::DOUBLE), (6.0::DOUBLE)),
g AS (SELECT h.* EXCLUDE (h1, h2), sparseness, CASE WHEN sparseness = 0 THEN h1 ELSE (1 + tanh(2 * (abs(h1) - sparseness * z1) / (z1 + 1e-12::DOUBLE))) / 2 * h1 END AS h1,
CASE WHEN sparseness = 0 THEN h2 ELSE (1 + tanh(2 * (abs(h2) - sparseness * z2) / (z2 + 1e-12::DOUBLE))) / 2 * h2 END AS h2 FROM h JOIN z USING (tol), k),
e AS (SELECT tol, sparseness, sum(h1*h1*e11 + h2*h2*e22 + (my-m1*h1-m2*h2)*(my-m1*h1-m2*h2)*w + eyy + 2*h1*h2*e12 + 2*h1*(my-m1*h1-m2*h2)*e1 + 2*h2*(my-m1*h1-m2*h2)*e2 - 2*h1*e1y - 2*h2*e2y - 2*(my-m1*h1-m2*h2)*ey) AS sse FROM g GROUP BY 1, 2)"""


@query(f"WITH {_GRID} SELECT tol, sparseness, round(1 - sse/t.sw/(t.syy/t.sw-(t.sy/t.sw)*(t.sy/t.sw)), 6) AS r2cv FROM e, t")
def direct_fit_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tolerances by sparsenesses, each set predicted by the others, from one pass of sums."""
    rows, _ = rg.direct_fit_grid(_moments(spark, sf_dir, True), _TOLS, [0.0, 1.0, 2.0, 6.0])
    return spark.createDataFrame([(r["tol"], r["sparseness"], round(r["r2cv"], 6)) for r in rows], "tol double, sparseness double, r2cv double")


@query(f"""WITH {FRAME_SQL}, s AS (SELECT folds.f, fr.* FROM fr JOIN (SELECT set_id, (row_number() OVER (ORDER BY set_id) - 1) % 3 AS f FROM (SELECT DISTINCT set_id FROM fr)) folds USING (set_id)),
l(penalty) AS (VALUES {", ".join(f"({t}::DOUBLE)" for t in _TOLS)}), k AS (SELECT DISTINCT f FROM s),
tr AS (SELECT k.f, sum(w) sw, sum(w*x1)/sum(w) m1, sum(w*x2)/sum(w) m2, sum(w*y)/sum(w) my, sum(w*x1*x1)/sum(w) s11, sum(w*x2*x2)/sum(w) s22, sum(w*x1*x2)/sum(w) s12, sum(w*x1*y)/sum(w) s1y, sum(w*x2*y)/sum(w) s2y FROM k JOIN s ON s.f <> k.f GROUP BY 1),
c AS (SELECT f, s11-m1*m1 a, s22-m2*m2 d, s12-m1*m2 b, s1y-m1*my p, s2y-m2*my q FROM tr),
h AS (SELECT f, penalty, ((d+penalty)*p-b*q)/((a+penalty)*(d+penalty)-b*b) h1, ((a+penalty)*q-b*p)/((a+penalty)*(d+penalty)-b*b) h2 FROM c, l),
v AS (SELECT h.f, penalty, h1*x1 + h2*x2 AS pred, y, w FROM s JOIN h USING (f)),
r AS (SELECT f, penalty, (sum(w*pred*y)/sum(w) - sum(w*pred)/sum(w)*sum(w*y)/sum(w)) / sqrt((sum(w*pred*pred)/sum(w) - (sum(w*pred)/sum(w))*(sum(w*pred)/sum(w))) * (sum(w*y*y)/sum(w) - (sum(w*y)/sum(w))*(sum(w*y)/sum(w)))) AS r FROM v GROUP BY 1, 2)
SELECT penalty, round(avg(r), 5) AS r FROM r GROUP BY 1""")
def penalty_by_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Penalties by the mean correlation over three folds of sets; folds' sums are sums of the sets'."""
    scores, *_ = rg.penalty_by_folds(_moments(spark, sf_dir, True), _TOLS)
    return spark.createDataFrame([(x["penalty"], round(x["r"], 5)) for x in scores], "penalty double, r double")


@query(f"""WITH RECURSIVE {_M}, g AS (SELECT 0 AS k, 0.0::DOUBLE AS h1, 0.0::DOUBLE AS h2, a, b, d, p, q FROM c UNION ALL SELECT k + 1, h1 - 50.0*(a*h1 + b*h2 - p), h2 - 50.0*(b*h1 + d*h2 - q), a, b, d, p, q FROM g WHERE k < 20)
SELECT k, round(h1, 6) AS h1, round(h2, 6) AS h2 FROM g WHERE k > 0""")
def grad_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = rg.gradient_descent(_moments(spark, sf_dir)[None], 50.0, 20)
    return spark.createDataFrame([(k + 1, round(float(h[0]), 6), round(float(h[1]), 6)) for k, h in enumerate(path)], "k int, h1 double, h2 double")


@query(f"""WITH RECURSIVE {_M}, g AS (SELECT 0 AS k, 0.0::DOUBLE AS h1, 0.0::DOUBLE AS h2, a, b, d, p, q FROM c UNION ALL
SELECT k + 1, CASE WHEN abs(a*h1 + b*h2 - p) >= abs(b*h1 + d*h2 - q) THEN h1 - 0.5*sign(a*h1 + b*h2 - p) ELSE h1 END, CASE WHEN abs(a*h1 + b*h2 - p) >= abs(b*h1 + d*h2 - q) THEN h2 ELSE h2 - 0.5*sign(b*h1 + d*h2 - q) END, a, b, d, p, q FROM g WHERE k < 20)
SELECT k, round(h1, 6) AS h1, round(h2, 6) AS h2 FROM g WHERE k > 0""")
def coord_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = rg.gradient_descent(_moments(spark, sf_dir)[None], 0.5, 20, coordinate=True)
    return spark.createDataFrame([(k + 1, round(float(h[0]), 6), round(float(h[1]), 6)) for k, h in enumerate(path)], "k int, h1 double, h2 double")


@query(f"WITH {FRAME_SQL} SELECT a.i::INT AS h1, b.i::INT AS h2, round(sum(w * (y - a.i * x1 - b.i * x2) * (y - a.i * x1 - b.i * x2)) / sum(w), 4) AS sse FROM fr, range(-3, 4) a(i), range(-3, 4) b(i) GROUP BY 1, 2")
def error_surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Squared error on a grid of two coefficients, evaluated from six sums instead of rows by grid points."""
    m = _moments(spark, sf_dir)[None]
    rows = [(a, b, round(float(m.squared_error(np.array([a, b], float), 0.0) / m.weight), 4)) for a in range(-3, 4) for b in range(-3, 4)]
    return spark.createDataFrame(rows, "h1 int, h2 int, sse double")


@query(f"""WITH {FRAME_SQL}, s AS (SELECT set_id, sum(w*y) s, sum(w) w FROM fr GROUP BY 1), l AS (SELECT set_id, (sum(s) OVER () - s) / (sum(w) OVER () - w) AS h FROM s), v AS (SELECT var_pop(h) v, count(*) n FROM l), x AS (SELECT set_id, h, sqrt(v * (n - 1)) AS sd FROM l, v)
SELECT set_id, round((1 + tanh(2 * (abs(h) - 6.0::DOUBLE * sd) / (sd + 1e-12::DOUBLE))) / 2 * h, 6) AS h FROM x""")
def sparse_shrink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delete-one means shrunk where they are under six of their jackknife deviations."""
    d = st.total_minus_own(frame(spark, sf_dir), ["set_id"], [], {"s": F.sum(F.col("w") * F.col("y")), "w": F.sum("w")}).select("set_id", (F.col("rest_s") / F.col("rest_w")).alias("h"))
    sd = d.agg(F.sqrt(F.var_pop("h") * (F.count("*") - 1)).alias("sd"))
    return d.crossJoin(F.broadcast(sd)).select("set_id", F.round(scalars.sparse_shrink(F.col("h"), F.col("sd"), 6.0), 6).alias("h"))  # one row


_PRED = f"{HOURLY_SQL}, f AS (SELECT a.band, a.t, a.n AS y, 0.5::DOUBLE * coalesce(lag(a.n) OVER (PARTITION BY a.band ORDER BY a.t), 0) + 0.3::DOUBLE AS pred FROM hourly a)"


def _forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    kernel = spark.createDataFrame([(1, 0.5)], "d int, w double")
    cells = hourly(spark, sf_dir)
    return sequences.convolve(cells, kernel, "band", "t", "n").join(cells, ["band", "t"]).select("band", "t", F.col("n").alias("y"), (F.col("pred") + 0.3).alias("pred"))


@query(f"""WITH {_PRED} SELECT band, round(0.5 * sum((pred - y) * (pred - y)), 4) AS linear, round(sum(exp(pred) - y * pred), 4) AS poisson,
round(sum(ln(1 + exp(pred)) - (y > 2)::INT * pred), 4) AS logistic FROM f GROUP BY 1""")
def lin_err(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Squared, Poisson and logistic errors of one prediction."""
    y, p = F.col("y"), F.col("pred")
    hit = (y > 2).cast("int")
    return _forward(spark, sf_dir).groupBy("band").agg(F.round(0.5 * F.sum((p - y) * (p - y)), 4).alias("linear"), F.round(F.sum(F.exp(p) - y * p), 4).alias("poisson"), F.round(F.sum(F.log(1 + F.exp(p)) - hit * p), 4).alias("logistic"))


@query(f"""WITH {_PRED}, e AS (SELECT band, t, pred - y AS e FROM f) SELECT e.band, d.i::INT AS d, round(sum(e.e * coalesce(h.n, 0)), 4) AS g FROM e, range(4) d(i) LEFT JOIN hourly h ON h.band = e.band AND h.t = e.t - d.i GROUP BY 1, 2""")
def lin_grad(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The error-triggered stimulus by delay."""
    e = _forward(spark, sf_dir).select("band", "t", (F.col("pred") - F.col("y")).alias("e")).withColumn("d", F.explode(F.sequence(F.lit(0), F.lit(3)))).withColumn("at", F.col("t") - F.col("d"))
    stim = hourly(spark, sf_dir).select("band", F.col("t").alias("at"), "n")
    return e.join(stim, ["band", "at"], "left").groupBy("band", "d").agg(F.round(F.sum(F.col("e") * F.coalesce("n", F.lit(0))), 4).alias("g"))


@query(f"WITH {_PRED} SELECT band, round(1 - avg((pred - y) * (pred - y)) / (avg(y * y) - avg(y) * avg(y)), 6) AS r2, round(corr(pred, y), 6) AS r, round(1 - var_pop(y - pred) / var_pop(y), 6) AS r2_var FROM f GROUP BY 1")
def r2_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _forward(spark, sf_dir).groupBy("band").agg(F.round(st.r2(F.col("pred"), F.col("y"), F.lit(1.0)), 6).alias("r2"), F.round(F.corr("pred", "y"), 6).alias("r"), F.round(1 - F.var_pop(F.col("y") - F.col("pred")) / F.var_pop("y"), 6).alias("r2_var"))


@query(f"""WITH {_PRED} SELECT band, t, round(greatest(pred - 1, 0) / max(greatest(pred - 1, 0)) OVER (PARTITION BY band) * max(y) OVER (PARTITION BY band), 6) AS scaled, least(greatest(pred - 1, 0), 1) AS clipped FROM f""")
def predict_rescale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions rectified and scaled to the response's largest; the maxima are aggregates joined back."""
    f = _forward(spark, sf_dir).withColumn("p", scalars.rectify(F.col("pred") - 1))
    top = f.groupBy("band").agg(F.max("p").alias("mp"), F.max("y").alias("my"))
    return f.join(top, "band").select("band", "t", F.round(F.col("p") / F.col("mp") * F.col("my"), 6).alias("scaled"), scalars.saturate(F.col("p")).alias("clipped"))


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").withColumn("y", (F.col("label") % 2).cast("double"))


@query()
def pca_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five principal directions of the embeddings from partial product matrices."""
    m = rg.total(rg.array_moments(_vectors(spark, sf_dir), "embedding", "y", "label"))
    s, u = rg.principal_components(m, 5)
    return spark.createDataFrame([(k, d, round(float(s[k]), 6), round(float(u[d, k]), 6)) for k in range(len(s)) for d in range(len(u))], "component int, d int, variance double, loading double")


@query()
def component_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regressions on the largest 10, 20, 50 and all 64 principal components; R2 over all rows."""
    m = rg.total(rg.array_moments(_vectors(spark, sf_dir), "embedding", "y", "label"))
    p, w = m.products, m.weight
    variance = p[-1, -1] / w - (p[-1, -2] / w) ** 2
    rows = [(k, float(1 - m.squared_error(*rg.component_regression(m, k)) / w / variance)) for k in (10, 20, 50, 64)]
    return spark.createDataFrame([(k, round(r, 6)) for k, r in rows], "components int, r2 double")


@query()
def ridge_vectors_loo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delete-one ridge of 64 channels over labels as sets."""
    rows = rg.ridge_loo(rg.array_moments(_vectors(spark, sf_dir), "embedding", "y", "label"), [0.2, 0.1, 0.05, 0.01, 0.005, 0.001])
    return spark.createDataFrame([(r["tol"], float(r["r2cv"])) for r in rows], "tol double, r2cv double")


@query()
def lars_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = rg.lars(rg.total(rg.array_moments(_vectors(spark, sf_dir), "embedding", "y", "label")), 10)
    return spark.createDataFrame([(n, d, float(v)) for n, h in path for d, v in enumerate(h) if v != 0], "step int, d int, h double")


@query()
def conjugate_gradient_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = rg.conjugate_gradient(rg.total(rg.array_moments(_vectors(spark, sf_dir), "embedding", "y", "label")), 64, 0.01)
    return spark.createDataFrame([(d, float(v)) for d, v in enumerate(h)], "d int, h double")


@query()
def group_ridge_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Banded ridge of four blocks of channels."""
    m = rg.total(rg.array_moments(_vectors(spark, sf_dir), "embedding", "y", "label"))
    h, gamma = rg.group_ridge(m, [list(range(k, k + 16)) for k in range(0, 64, 16)], 100, 0.01)
    return spark.createDataFrame([(d, float(v), float(gamma[d // 16])) for d, v in enumerate(h)], "d int, h double, scale double")


@query()
def logistic_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Odd and even labels told apart from the vectors."""
    rows = _vectors(spark, sf_dir).select("vec_id", array_to_vector(F.transform("embedding", lambda v: v.cast("double"))).alias("features"), F.col("y").alias("label"))
    model = LogisticRegression(maxIter=20, regParam=0.01).fit(rows)
    return model.transform(rows).select("vec_id", vector_to_array("probability")[1].alias("p"), F.col("prediction"))


@query()
def logistic_delayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The busiest band of an hour (the first by name among equals) told from the counts of all bands one to three hours before: multinomial regression fitted to four days of five, with its accuracy on the fifth."""
    cells = hourly(spark, sf_dir)
    most = cells.groupBy("t").agg(F.max("n").alias("n"))
    busiest = cells.join(most, ["t", "n"]).groupBy("t").agg(F.min("band").alias("band"))
    names = cells.select("band").distinct().withColumn("label", (F.row_number().over(Window.orderBy("band")) - 1).cast("double"))  # a short list of bands
    ahead = cells.select("band", "n", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("delay"), "t").withColumn("t", F.col("t") + F.col("delay"))
    x = ahead.groupBy("t").agg(F.sort_array(F.collect_list(F.struct("band", "delay", "n"))).alias("x"), F.count("*").alias("k"))
    full = names.agg((F.count("*") * 3).alias("full"))
    rows = x.crossJoin(F.broadcast(full)).where("k = full").join(busiest, "t").join(F.broadcast(names), "band")  # one row; a row a band
    rows = rows.select("t", "label", array_to_vector(F.transform("x", lambda v: v["n"].cast("double"))).alias("features"))
    held = F.floor(F.col("t") / 24) % 5 == 4
    model = LogisticRegression(family="multinomial", maxIter=50, regParam=0.01, tol=1e-8).fit(rows.where(~held))
    return model.transform(rows.where(held)).groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg((F.col("prediction") == F.col("label")).cast("double")), 6).alias("accuracy"))


def _band_frames(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str]]:
    """(s, t, x, y, w): hours dealt to sets of six days, the counts of all other bands by name, and of purchases."""
    cells = hourly(spark, sf_dir)
    found = cells.where("band <> 'purchase'").select("band").distinct().limit(MAX_BANDS + 1).collect()
    if len(found) > MAX_BANDS:
        raise ValueError(f"over {MAX_BANDS} bands")
    x = cells.where("band <> 'purchase'").groupBy("t").agg(F.transform(F.array_sort(F.collect_list(F.struct("band", "n"))), lambda v: v["n"].cast("double")).alias("x"))
    rows = x.join(cells.where("band = 'purchase'").select("t", F.col("n").alias("y")), "t")
    return rows.select(F.floor(F.col("t") / 144).alias("s"), (F.col("t") % 144).alias("t"), "x", "y", F.lit(1.0).alias("w")), sorted(r.band for r in found)


#: A system of a frequency has the square of this many numbers.
MAX_BANDS = 2048


@query()
def receptive_field_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A spectro-temporal filter of purchases on all other bands, from all sets (s null) and without each, over twelve hours either way: its values and their jackknife deviations."""
    rows, bands = _band_frames(spark, sf_dir)
    f = direct_fit.frames(rows, "s", "t", "x", "y", "w", len(bands), 12)
    names = F.array(*(F.lit(b) for b in bands))
    found = direct_fit.filters(f, 12, [0.01]).join(f.names.select("p", "s"), "p", "left")
    each = found.select("s", F.get(names, F.col("i")).alias("band"), F.posexplode(F.arrays_zip("h", "sd")).alias("k", "v"))
    return each.select("s", "band", (F.col("k") - 12).alias("lag"), F.round("v.h", 9).alias("h"), F.round("v.sd", 9).alias("sd"))


@query()
def direct_fit_lagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases from all other bands over the last twelve hours: R2 and bits of left-out sets for eight tolerances and four sparsenesses, the one of most bits marked. A day is a window, an hour a sample."""
    rows, bands = _band_frames(spark, sf_dir)
    f = direct_fit.frames(rows, "s", "t", "x", "y", "w", len(bands), direct_fit.reach_of(12, 5, 24.0, 1.0))
    got = direct_fit.fit(f, 12, range(0, 12), list(direct_fit.TOLERANCES), list(direct_fit.SPARSENESSES), 5, 24.0, 10.0, 1.0)
    return spark.createDataFrame([(g["tol"], g["sparseness"], round(g["r2cv"], 9), round(g["bits"], 9), g is got.best) for g in got.grid], "tol double, sparseness double, r2cv double, bits double, best boolean")


@query()
def separable_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filters of the embeddings' 64 channels over eight rows either way for odd labels, from correlations of channels and of lags alone: of all sets (s null) and without each set of 100 rows."""
    rows = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 100).alias("s"), (F.col("vec_id") % 100).alias("t"), "embedding", (F.col("label") % 2).alias("y"), F.lit(1.0).alias("w"))
    f = direct_fit.frames(rows, "s", "t", "embedding", "y", "w", 64, 16)
    found = direct_fit.separable_filters(f, 8, [0.05]).join(f.names.select("p", "s"), "p", "left")
    each = found.select("s", F.col("i").alias("channel"), F.posexplode(F.arrays_zip("h", "sd")).alias("k", "v"))
    return each.select("s", "channel", (F.col("k") - 8).alias("lag"), F.round("v.h", 9).alias("h"), F.round("v.sd", 9).alias("sd"))


@query()
def lasso_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Knots of the lasso and of an elastic net from the channels of the embeddings to odd labels: penalty, variables, risk and the coefficients that are not 0."""
    m = rg.total(rg.array_moments(_vectors(spark, sf_dir), "embedding", "y", "label"))
    rows = []
    for kind, ridge in (("lasso", 0.0), ("elastic net", 0.5)):
        knots, scale = rg.lasso_path(m, ridge)
        rows += [(kind, k, d, round(float(v), 9), round(float(x.penalty), 9), len(x.active), round(x.risk, 6)) for k, x in enumerate(knots) for d, v in enumerate(x.coef / scale) if v != 0]
    return spark.createDataFrame(rows, "kind string, knot int, d int, h double, penalty double, variables int, risk double")


@query("""WITH e AS (SELECT vec_id, label % 2 AS y, unnest(embedding)::DOUBLE AS v, unnest(range(64)) AS i FROM embeddings),
b AS (SELECT i, covar_pop(v, y) / stddev_pop(v) AS r FROM e GROUP BY 1), f AS (SELECT i, r, abs(r) AS lam FROM b ORDER BY abs(r) DESC, i LIMIT 1),
c AS (SELECT a.i, corr(a.v, z.v) * sign(f.r) AS k FROM e a JOIN e z USING (vec_id) JOIN f ON z.i = f.i GROUP BY a.i, f.r),
s AS (SELECT b.i, unnest([(lam - b.r) / (1 - k), (lam + b.r) / (1 + k)]) AS step FROM b JOIN c USING (i), f WHERE b.i <> f.i),
n AS (SELECT i, step FROM s WHERE step > 0 ORDER BY step LIMIT 1)
SELECT f.i::INT AS first, n.i::INT AS second, round(lam, 6) AS penalty, round(lam - step, 6) AS next_penalty FROM f, n""")
def lasso_first_knot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The channel that comes into the lasso first and the one that comes next, with their penalties."""
    knots, _ = rg.lasso_path(rg.total(rg.array_moments(_vectors(spark, sf_dir), "embedding", "y", "label")), most=3)
    first, second = knots[1].active, knots[2].active
    return spark.createDataFrame([(int(first[0]), next(iter(set(second) - set(first)), None), round(float(knots[0].penalty), 6), round(float(knots[1].penalty), 6))], "first int, second int, penalty double, next_penalty double")
