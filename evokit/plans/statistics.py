"""Queries on weighted moments, delete-one statistics, scaling and resampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evokit.catalog import query
from evokit.operators import statistics as st
from evokit.session import table


def frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as a weighted regression frame: w, x1, x2, y by set."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.concat("l_returnflag", "l_linestatus").alias("set_id"), F.col("l_quantity").alias("w"), F.col("l_discount").alias("x1"), F.col("l_tax").alias("x2"), (F.col("l_extendedprice") / 1000).alias("y"), "l_orderkey", "l_linenumber")


FRAME_SQL = "fr AS (SELECT l_returnflag || l_linestatus AS set_id, l_quantity AS w, l_discount AS x1, l_tax AS x2, l_extendedprice / 1000 AS y, l_orderkey, l_linenumber FROM lineitem)"


@query(f"""WITH {FRAME_SQL}, s AS (SELECT set_id, sum(w) sw, sum(w*x1) sx, sum(w*y) sy, sum(w*x1*x1) sxx, sum(w*y*y) syy, sum(w*x1*y) sxy FROM fr GROUP BY 1),
c AS (SELECT set_id, sx/sw AS mean_x, sy/sw AS mean_y, sxy/sw - (sx/sw)*(sy/sw) AS cov_xy, sxx/sw - (sx/sw)*(sx/sw) AS vx, syy/sw - (sy/sw)*(sy/sw) AS vy FROM s)
SELECT set_id, round(mean_x, 6) AS mean_x, round(mean_y, 6) AS mean_y, round(cov_xy, 6) AS cov_xy, round(cov_xy / sqrt(vx * vy), 6) AS corr_xy FROM c""")
def weighted_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = st.weighted_moments(F.col("x1"), F.col("y"), F.col("w"))
    return frame(spark, sf_dir).groupBy("set_id").agg(*(F.round(c, 6).alias(k) for k, c in m.items()))


@query(f"""WITH {FRAME_SQL}, m AS (SELECT (sum(x1) + sum(x2)) / (2 * count(*)) AS m FROM fr) SELECT round(sum((x1 - m) * (x2 - m)) / sqrt(sum((x1 - m) * (x1 - m)) * sum((x2 - m) * (x2 - m))), 6) AS corr FROM fr, m""")
def pearson_common_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.pooled_correlation(frame(spark, sf_dir), "x1", "x2").select(F.round("corr", 6).alias("corr"))


@query("""WITH p AS (SELECT p_brand, sum(l_extendedprice * l_quantity) s, sum(l_quantity) w FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1)
SELECT p_brand, round(s / w, 4) AS own, round((sum(s) OVER () - s) / nullif(sum(w) OVER () - w, 0), 4) AS rest FROM p""")
def loo_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted mean price of each brand and of all others: total less own."""
    rows = table(spark, sf_dir, "lineitem").select("l_partkey", "l_quantity", "l_extendedprice").join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey")
    d = st.total_minus_own(rows, ["p_brand"], [], {"s": F.sum(F.col("l_extendedprice") * F.col("l_quantity")), "w": F.sum("l_quantity")})
    return d.select("p_brand", F.round(F.col("s") / F.col("w"), 4).alias("own"), F.round(F.col("rest_s") / F.expr("nullif(rest_w, 0)"), 4).alias("rest"))


@query("""WITH p AS (SELECT user_id, hour(ts)::INT AS h, sum(round(value * 100)::BIGINT)::BIGINT s, count(*) n FROM events GROUP BY 1, 2)
SELECT user_id, h, round((sum(s) OVER (PARTITION BY h) - s)::DOUBLE / greatest(sum(n) OVER (PARTITION BY h) - n, 1), 8) AS rest FROM p""")
def loo_mean_by_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean value, in cents, by hour of day without the user's own events; a count of zero is taken as one.

    Hours are few, so totals by hour are an aggregate that is joined back by broadcast (24 rows), not a window.
    """
    e = table(spark, sf_dir, "events").select("user_id", F.hour("ts").alias("h"), F.round(F.col("value") * 100).cast("long").alias("cents"))
    own = e.groupBy("user_id", "h").agg(F.sum("cents").alias("s"), F.count("*").alias("n"))
    total = own.groupBy("h").agg(F.sum("s").alias("ts"), F.sum("n").alias("tn"))
    return own.join(F.broadcast(total), "h").select("user_id", "h", F.round((F.col("ts") - F.col("s")) / F.greatest(F.col("tn") - F.col("n"), F.lit(1)), 8).alias("rest"))


_CELLS = "x AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1)::INT AS d FROM embeddings)"


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("p", "f")).select("vec_id", "label", (F.col("p") + 1).alias("d"), F.col("f").cast("double").alias("v"))


@query(f"WITH {_CELLS} SELECT label, d, round(avg(v), 6) AS m, count(*) AS n FROM x GROUP BY 1, 2")
def stim_mean_by_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells(spark, sf_dir).groupBy("label", "d").agg(F.round(F.avg("v"), 6).alias("m"), F.count("*").alias("n"))


@query(f"WITH {_CELLS}, s AS (SELECT d, avg(v) m, stddev_samp(v) sd FROM x GROUP BY 1) SELECT vec_id, d, round((v - m) / CASE WHEN coalesce(sd, 0) = 0 THEN 1 ELSE sd END, 5) AS z FROM x JOIN s USING (d)")
def zscore_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.z_scores(cells(spark, sf_dir), "d", "v").select("vec_id", "d", F.round("z", 5).alias("z"))


@query(f"WITH {_CELLS}, n AS (SELECT count(*)::DOUBLE AS n FROM embeddings) SELECT d, round(sum(CASE WHEN label = 3 THEN v ELSE 0 END) / any_value(n), 6) AS sta FROM x, n GROUP BY d")
def spike_triggered_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of one label are spikes; their sum by channel over the number of all frames."""
    n = table(spark, sf_dir, "embeddings").agg(F.count("*").alias("n"))
    s = cells(spark, sf_dir).groupBy("d").agg(F.sum(F.when(F.col("label") == 3, F.col("v")).otherwise(0.0)).alias("s"))
    return s.crossJoin(F.broadcast(n)).select("d", F.round(F.col("s") / F.col("n"), 6).alias("sta"))  # one row


@query(f"""WITH {_CELLS}, y AS (SELECT * FROM x WHERE label = 3), m AS (SELECT d, avg(v) m FROM y GROUP BY 1), c AS (SELECT vec_id, d, v - m AS v FROM y JOIN m USING (d))
SELECT a.d AS d1, b.d AS d2, round(avg(a.v * b.v), 6) + 0.0::DOUBLE AS cov FROM c a JOIN c b USING (vec_id) WHERE a.d <= b.d GROUP BY 1, 2""")
def stc_cov(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Covariance of the triggering frames over all channels."""
    return st.pair_covariances(table(spark, sf_dir, "embeddings").where("label = 3"), "embedding").select("d1", "d2", F.round("cov", 6).alias("cov"))


@query("""SELECT vec_id, a.i::INT AS d1, b.i::INT AS d2, round(embedding[a.i]::DOUBLE * embedding[b.i]::DOUBLE, 6) + 0.0::DOUBLE AS p FROM embeddings, unnest(range(1, len(embedding) + 1)) a(i), unnest(range(1, len(embedding) + 1)) b(i) WHERE a.i <= b.i AND b.i - a.i <= 2""")
def second_order_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products of channels at most two apart; the SQL adds 0 to make -0 a 0, as Spark's round does."""
    return st.near_products(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 2).withColumn("p", F.round("p", 6))


@query()
def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles of the mean price by month of shipping over 100 resamples of all rows."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.date_format("l_shipdate", "yyyy-MM").alias("month"), (F.col("l_extendedprice") / 1000).alias("y"))
    return st.bootstrap_means(li, ["l_orderkey", "l_linenumber"], "month", "y").select("month", *(F.round(c, 4).alias(c) for c in ("mean", "lower", "upper")), "n", "draws")


@query("SELECT c_custkey, (('0x' || substr(md5(c_custkey::VARCHAR || ':fold'), 1, 6))::INT % 5)::INT AS fold FROM customer")
def kfold_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folds by hash: no order over all rows is needed."""
    h = F.conv(F.substring(F.md5(F.concat(F.col("c_custkey").cast("string"), F.lit(":fold"))), 1, 6), 16, 10).cast("long")
    return table(spark, sf_dir, "customer").select("c_custkey", (h % 5).cast("int").alias("fold"))


@query("SELECT g, (ntile(4) OVER (ORDER BY g))::INT AS fold FROM (SELECT DISTINCT p_brand AS g FROM part)")
def kfold_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contiguous folds of groups (brands, a short list), the remainder over the first folds."""
    return table(spark, sf_dir, "part").select(F.col("p_brand").alias("g")).distinct().withColumn("fold", F.ntile(4).over(Window.orderBy("g")))


@query(f"""WITH {FRAME_SQL}, s AS (SELECT set_id, sum(w*y) s, sum(w) w FROM fr GROUP BY 1), l AS (SELECT (sum(s) OVER () - s) / (sum(w) OVER () - w) AS m FROM s)
SELECT round(avg(m), 6) AS mean, round(sqrt(var_pop(m) * (count(*) - 1)), 6) AS jackknife_sd, count(*) AS n FROM l""")
def jackknife_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = st.total_minus_own(frame(spark, sf_dir), ["set_id"], [], {"s": F.sum(F.col("w") * F.col("y")), "w": F.sum("w")}).select((F.col("rest_s") / F.col("rest_w")).alias("m"))
    return d.agg(F.round(F.avg("m"), 6).alias("mean"), F.round(F.sqrt(F.var_pop("m") * (F.count("*") - 1)), 6).alias("jackknife_sd"), F.count("*").alias("n"))


@query("SELECT event_type, user_id, round(value - avg(value) OVER (PARTITION BY user_id, event_type), 9) AS v, event_id FROM events")
def demean_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values less the mean of their group, which is aggregated first and joined back."""
    e = table(spark, sf_dir, "events").select("event_id", "event_type", "user_id", "value")
    m = e.groupBy("user_id", "event_type").agg(F.avg("value").alias("m"))
    return e.join(m, ["user_id", "event_type"]).select("event_type", "user_id", F.round(F.col("value") - F.col("m"), 9).alias("v"), "event_id")
