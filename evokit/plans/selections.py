"""Queries on filters, picks and short sums, and on single-trial signal to noise."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evokit.catalog import query
from evokit.functions import scalars
from evokit.operators import sequences
from evokit.operators import statistics as st
from evokit.plans.events import HOURLY_SQL, hourly
from evokit.plans.signals import _COH, _coherence
from evokit.plans.statistics import _CELLS, cells
from evokit.session import table
from evokit.streaming import windows


@query("SELECT c_custkey, c_nationkey FROM customer WHERE c_mktsegment = 'BUILDING'")
def filter_good_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey", "c_nationkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority = '1-URGENT' AND o_totalprice > 1000")
def query_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").where("o_orderstatus = 'O' and o_orderpriority = '1-URGENT' and o_totalprice > 1000").select("o_orderkey")


@query(f"WITH {_CELLS} SELECT vec_id, d, v FROM x WHERE d BETWEEN 9 AND 24")
def select_band_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Channels 9 to 24, sliced within each frame."""
    part = F.slice("embedding", 9, 16)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(part).alias("p", "f")).select("vec_id", (F.col("p") + 9).alias("d"), F.col("f").cast("double").alias("v"))


@query(f"WITH {HOURLY_SQL} SELECT band, t, n FROM hourly WHERE n > 0")
def weight_positive_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hourly(spark, sf_dir).where("n > 0")


@query(f"""WITH {HOURLY_SQL}, l AS (SELECT band, max(t) + 1 AS len FROM hourly WHERE n > 0 AND band IN ('view', 'purchase') GROUP BY 1), m AS (SELECT min(len) AS len FROM l)
SELECT v.t, v.n AS x, p.n AS y FROM hourly v JOIN hourly p ON p.t = v.t AND p.band = 'purchase', m WHERE v.band = 'view' AND v.t < m.len""")
def truncate_to_min_len(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views and purchases, each as long as to its last event, cut to the shorter one."""
    h = hourly(spark, sf_dir).where("band in ('view', 'purchase')")
    length = h.where("n > 0").groupBy("band").agg((F.max("t") + 1).alias("len")).agg(F.min("len").alias("len"))
    x, y = (h.where(F.col("band") == b).select("t", F.col("n").alias(c)) for b, c in (("view", "x"), ("purchase", "y")))
    return x.join(y, "t").crossJoin(F.broadcast(length)).where("t < len").drop("len")  # one row


@query("SELECT label, count(*) AS n, min(vec_id) AS first, max(vec_id) AS last FROM embeddings GROUP BY 1")
def gather_group_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").groupBy("label").agg(F.count("*").alias("n"), F.min("vec_id").alias("first"), F.max("vec_id").alias("last"))


@query("SELECT vec_id FROM embeddings WHERE label IN (2, 5)")
def find_idx(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = spark.createDataFrame([(2,), (5,)], "label int")
    return table(spark, sf_dir, "embeddings").join(F.broadcast(wanted), "label", "left_semi").select("vec_id")  # a list of two


@query(f"""WITH {_CELLS} SELECT d, round(sum(v * (label + 1)) / sum(label + 1), 6) AS m, round(sum(log10(abs(v) + 1) * (label + 1)) / sum(label + 1), 6) AS log_m FROM x GROUP BY d""")
def stim_mean_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted means of channels, of the values and of the logarithms of one more than their size."""
    w = F.col("label") + 1
    mean = lambda v: F.round(F.sum(v * w) / F.sum(w), 6)
    return cells(spark, sf_dir).groupBy("d").agg(mean(F.col("v")).alias("m"), mean(F.log10(F.abs("v") + 1)).alias("log_m"))


@query("""WITH u AS (SELECT user_id, count(*) FILTER (event_type = 'view') AS trials, count(*) AS len, sum(round(value * 100)::BIGINT)::BIGINT AS s FROM events GROUP BY 1)
SELECT round(sum(trials * s)::DOUBLE / sum(trials * len), 6) AS stim_mean, round(sum(len)::DOUBLE / sum(trials), 6) AS rate, count(*) AS sets FROM u WHERE trials > 0""")
def pandas_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean stimulus (in cents) weighted by trials and length of each unit, and the response a trial."""
    u = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.when(F.col("event_type") == "view", 1)).alias("trials"), F.count("*").alias("len"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("s"))
    u = u.where("trials > 0")
    return u.agg(F.round(F.sum(F.col("trials") * F.col("s")) / F.sum(F.col("trials") * F.col("len")), 6).alias("stim_mean"), F.round(F.sum("len") / F.sum("trials"), 6).alias("rate"), F.count("*").alias("sets"))


_SNR = f"""{HOURLY_SQL}, days AS (SELECT ((max(t) + 1) // 24) // 2 * 2 AS k FROM hourly), p AS (SELECT band, (t // 24) % 2 AS half, t % 24 AS u, sum(n)::DOUBLE AS n FROM hourly, days WHERE t // 24 < k GROUP BY 1, 2, 3),
r AS (SELECT a.band, corr(a.n, b.n) AS r, any_value(k) AS k FROM p a JOIN p b ON a.band = b.band AND a.u = b.u AND a.half = 0 AND b.half = 1, days GROUP BY 1 HAVING var_pop(a.n) > 0 AND var_pop(b.n) > 0)"""


def _snr(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = hourly(spark, sf_dir)
    days = h.agg((F.floor((F.max("t") + 1) / 48) * 2).alias("k"))
    return st.single_trial_snr(h.crossJoin(F.broadcast(days)), "band", F.floor(F.col("t") / 24), F.col("t") % 24, "n", "k")  # one row


@query(f"WITH {_SNR} SELECT band, round(r, 6) AS r, round(2 * r / (1 - r) / k, 8) AS snr FROM r")
def snr_single_trial(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days as trials, an even number of them: correlation of the mean days of alternate halves, and what it says of one day."""
    return _snr(spark, sf_dir).select("band", F.round("r", 6).alias("r"), F.round("snr", 8).alias("snr"))


@query(f"WITH {_SNR}, s AS (SELECT 2 * r / (1 - r) / k AS snr, k FROM r) SELECT round(sum(snr * k) / sum(1 + snr * k), 6) AS ev FROM s")
def ev_from_snr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of variance that a model of the means can explain, over all bands."""
    s = _snr(spark, sf_dir)
    return s.agg(F.round(F.sum(F.col("snr") * F.col("k")) / F.sum(1 + F.col("snr") * F.col("k")), 6).alias("ev"))


@query("SELECT count(DISTINCT user_id) AS users, count(DISTINCT event_type) AS kinds FROM events")
def unique_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").agg(F.count_distinct("user_id").alias("users"), F.count_distinct("event_type").alias("kinds"))


@query("SELECT event_type, round(sum(value) FILTER (value >= 10), 2) AS s, round(avg(value) FILTER (value >= 10), 6) AS m FROM events GROUP BY 1")
def nansum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums and means that leave NaN out; values under ten stand for NaN."""
    v = scalars.skip_nan(F.when(F.col("value") < 10, F.lit(float("nan"))).otherwise(F.col("value")))
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.round(F.sum(v), 2).alias("s"), F.round(F.avg(v), 6).alias("m"))


@query("SELECT label, n, (sum(n) OVER (ORDER BY label))::BIGINT AS boundary FROM (SELECT label, count(*) AS n FROM embeddings GROUP BY 1)")
def cumulative_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each set ends in the frames laid end to end; the sets, one row each, are few."""
    n = table(spark, sf_dir, "embeddings").groupBy("label").agg(F.count("*").alias("n"))
    return n.withColumn("boundary", F.sum("n").over(Window.orderBy("label")))


_RUNS = """SELECT band, kind, min(t) AS a, max(t) AS z, any_value(v) AS v, row_number() OVER (PARTITION BY band, kind ORDER BY min(t)) AS i FROM (SELECT *, sum(c) OVER (PARTITION BY band, kind ORDER BY t ROWS UNBOUNDED PRECEDING) AS run
FROM (SELECT *, coalesce((v <> lag(v) OVER (PARTITION BY band, kind ORDER BY t))::INT, 1) AS c FROM s)) GROUP BY band, kind, run"""


@query(f"""WITH {HOURLY_SQL}, d AS (SELECT band, t, lead(n) OVER (PARTITION BY band ORDER BY t) - n AS diff FROM hourly), s AS (SELECT band, t, k.i AS kind, CASE WHEN k.i = 1 THEN diff ELSE -diff END AS v FROM d, range(2) k(i) WHERE diff IS NOT NULL),
r AS ({_RUNS}), p AS (SELECT *, lag(v) OVER w AS before, lead(v) OVER w AS after FROM r WINDOW w AS (PARTITION BY band, kind ORDER BY i)),
e AS (SELECT band, (a + z) // 2 AS t, kind, v FROM p WHERE before < v AND after < v AND v >= 2)
SELECT band, t, kind::INT AS onset, (1 - kind)::INT AS offset, round(v::DOUBLE / max(v) OVER (PARTITION BY band, kind), 6) AS value FROM e""")
def onset_offset_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Onsets and offsets of hourly activity: peaks of its rise and of its fall."""
    return sequences.onset_offset_events(hourly(spark, sf_dir), "band", "t", "n", 2.0).withColumn("value", F.round("value", 6))


@query(f"""WITH {HOURLY_SQL}, s AS (SELECT band, 0 AS kind, t, n AS v FROM hourly), r AS ({_RUNS}), p AS (SELECT *, lag(v) OVER w AS before, lead(v) OVER w AS after FROM r WINDOW w AS (PARTITION BY band, kind ORDER BY i))
SELECT band, (a + z) // 2 AS t, v AS n FROM p WHERE before < v AND after < v AND v >= 3""")
def peak_find(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Peaks with the middle of flat tops."""
    return sequences.plateau_peaks(hourly(spark, sf_dir), "band", "t", "n", 3.0)


@query(f"""WITH {HOURLY_SQL}, k(d, w) AS (VALUES (-1, 0.25::DOUBLE), (0, 0.5::DOUBLE), (1, 0.25::DOUBLE))
SELECT a.band, a.t, round(sum(w * coalesce(b.n, 0)), 6) AS pred FROM hourly a, k LEFT JOIN hourly b ON b.band = a.band AND b.t = a.t - d GROUP BY 1, 2""")
def dotdelay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delay lines centred on each hour."""
    kernel = spark.createDataFrame([(-1, 0.25), (0, 0.5), (1, 0.25)], "d int, w double")
    return sequences.convolve(hourly(spark, sf_dir), kernel, "band", "t", "n").select("band", "t", F.round("pred", 6).alias("pred"))


@query(f"WITH {_CELLS}, m AS (SELECT label, d, round(avg(v), 6) AS info FROM x GROUP BY 1, 2) SELECT label, d, info FROM m ORDER BY info DESC, label, d LIMIT 1")
def best_info_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best of a grid, here of labels by channels; the first of equal ones."""
    grid = cells(spark, sf_dir).groupBy("label", "d").agg(F.round(F.avg("v"), 6).alias("info"))
    return grid.orderBy(F.desc("info"), "label", "d").limit(1)


@query("SELECT vec_id, label FROM embeddings WHERE label < 3")
def limit_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three sets, whole."""
    return table(spark, sf_dir, "embeddings").where("label < 3").select("vec_id", "label")


@query("SELECT c_custkey FROM customer ORDER BY md5(c_custkey::VARCHAR || ':pick'), c_custkey LIMIT 1")
def random_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.hashed_sample(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", "pick", 1)


@query("SELECT c_custkey FROM customer ORDER BY md5(c_custkey::VARCHAR || ':sample'), c_custkey LIMIT 40")
def randsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forty units without replacement."""
    return st.hashed_sample(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", "sample", 40)


@query("""SELECT vec_id, i::INT AS i, CASE WHEN i >= 16 THEN coalesce(embedding[i - 15]::DOUBLE, 0.0) ELSE 0.0 END AS v FROM embeddings, range(100) r(i)""")
def pad_silence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen silent samples ahead, then silence up to a hundred samples in all; longer clips are trimmed."""
    clip = sequences.padded(F.transform("embedding", lambda v: v.cast("double")), 16, 100)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(clip).alias("i", "v"))


@query("SELECT i::INT AS k, round(CASE WHEN i = 0 THEN 1 ELSE sin(pi() * i / 4) / (pi() * i / 4) * sin(pi() * i / 24) / (pi() * i / 24) END, 9) + 0.0::DOUBLE AS w FROM range(-24, 25) r(i)")
def lanczos_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A windowed sinc of a quarter of the sampling rate over 24 samples on either side."""
    sinc = lambda x: F.when(x == 0, 1.0).otherwise(F.sin(math.pi * x) / (math.pi * x))
    k = spark.range(-24, 25).select(F.col("id").cast("int").alias("k"))
    return k.select("k", (F.round(sinc(F.col("k") / 4) * sinc(F.col("k") / 24), 9) + F.lit(0.0)).alias("w"))


@query(f"WITH {_COH} SELECT round(avg(c), 6) AS coherence, count(*) AS n FROM co WHERE f BETWEEN 1 AND 8")
def coherence_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean coherence from one to eight cycles a day."""
    return _coherence(spark, sf_dir).where("f between 1 and 8").agg(F.round(F.avg("coherence"), 6).alias("coherence"), F.count("*").alias("n"))


@query(f"WITH {_CELLS}, s AS (SELECT d, avg(v) m, stddev_pop(v) sd FROM x GROUP BY 1) SELECT vec_id, d, round((v - m) / CASE WHEN coalesce(sd, 0) = 0 THEN 1 ELSE sd END, 5) AS z FROM x JOIN s USING (d)")
def standard_scaler(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.z_scores(cells(spark, sf_dir), "d", "v", sample=False).select("vec_id", "d", F.round("z", 5).alias("z"))


@query("""WITH e AS (SELECT event_type, epoch_us(ts) // 3600000000 * 3600000000 AS h, round(value * 100)::BIGINT AS v FROM events), w AS (SELECT event_type, h - k.i * 3600000000 AS start_us, v FROM e, range(2) k(i))
SELECT event_type, start_us, round(avg(v), 6) AS mean, count(*) AS n FROM w GROUP BY 1, 2""")
def overlap_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean values (in cents) of half-overlapping chunks of two hours: the streaming operator over the batch table."""
    e = table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", F.round(F.col("value") * 100).cast("long").alias("v"))
    return windows.overlapping_means(e, "ts", "event_type", "v", "2 hours", "1 hour", "1 hour").select("event_type", F.unix_micros("start").alias("start_us"), F.round("mean", 6).alias("mean"), "n")


_POISSON = [float(c) for c in st._POISSON_CDF]


@query(f"""WITH o AS (SELECT o_orderkey, o_custkey % 40 AS g, round(o_totalprice * 100)::BIGINT AS v FROM orders), gs AS (SELECT DISTINCT g FROM o), k AS (SELECT i::INT AS draw FROM range(10) r(i)),
t AS (SELECT draw, g, row_number() OVER (PARTITION BY draw ORDER BY md5(g::VARCHAR || ':' || draw::VARCHAR), g) <= (SELECT ceil(0.1 * count(*)) FROM gs) AS test FROM gs, k),
u AS (SELECT draw, test, v, ('0x' || substr(md5(o_orderkey::VARCHAR || ':' || draw::VARCHAR), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS p FROM o JOIN t USING (g)),
w AS (SELECT draw, test, v, {" + ".join(f"(p >= {c!r}::DOUBLE)::INT" for c in _POISSON)} AS w FROM u)
SELECT draw, test, sum(w)::BIGINT AS n, round(sum(w * v)::DOUBLE / sum(w), 4) AS mean FROM w GROUP BY 1, 2""")
def resample_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten draws: a tenth of the groups is set apart, then the rows of either side are drawn with replacement (Poisson weights)."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 40).alias("g"), F.round(F.col("o_totalprice") * 100).cast("long").alias("v"))
    w = st.group_bootstrap(o, "g", "o_orderkey", 10, 0.1)
    return w.groupBy("draw", "test").agg(F.sum("w").cast("long").alias("n"), F.round(F.sum(F.col("w") * F.col("v")) / F.sum("w"), 4).alias("mean"))
