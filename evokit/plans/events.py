"""Queries on the table events: users are units, views start trials, clicks are spikes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evokit.catalog import query
from evokit.operators import histograms, intervals, sequences, statistics
from evokit.session import table

HOUR, DAY = 3_600_000_000, 86_400_000_000


def micros(events: DataFrame) -> DataFrame:
    return events.withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")))


def trials_and_spikes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    events = micros(table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type"))
    last = events.agg(F.max("t").alias("last"))
    views = events.where("event_type = 'view'").crossJoin(F.broadcast(last))  # one row
    trials = views.select("user_id", F.col("event_id").alias("trial"), F.col("t").alias("start"), F.least(F.col("t") + DAY, F.col("last")).alias("stop"))
    return trials, events.where("event_type = 'click'").select("user_id", "t")


def aligned_spikes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    trials, spikes = trials_and_spikes(spark, sf_dir)
    return trials, intervals.points_in_intervals(spikes, trials, "user_id", "t", "start", "stop", DAY).withColumn("offset", F.col("t") - F.col("start"))


_BASE = """m AS (SELECT max(epoch_us(ts)) mx FROM events),
tr AS (SELECT user_id, event_id AS trial, epoch_us(ts) AS s, least(epoch_us(ts) + 86400000000, mx) AS e FROM events, m WHERE event_type = 'view'),
sp AS (SELECT user_id, epoch_us(ts) AS t FROM events WHERE event_type = 'click'),
al AS (SELECT tr.user_id, trial, t - s AS o, t FROM tr JOIN sp ON tr.user_id = sp.user_id AND t >= s AND t < e)"""


@query(f"""WITH {_BASE},
b AS (SELECT u.user_id, r.i AS bin FROM (SELECT DISTINCT user_id FROM tr) u, range(24) r(i)),
c AS (SELECT user_id, CAST(round_even(o / 3600000000.0, 0) AS INT) AS bin, count(*) n FROM al GROUP BY 1, 2),
w AS (SELECT b.user_id, b.bin, count(*) FILTER ((e - s) / 3600000000.0 >= b.bin) w FROM b JOIN tr USING (user_id) GROUP BY 1, 2)
SELECT b.user_id, CAST(b.bin AS INT) AS bin, coalesce(n, 0)::BIGINT AS n_spikes, w.w::BIGINT AS weight, round(CASE WHEN w.w > 0 THEN coalesce(n, 0)::DOUBLE / w.w ELSE coalesce(n, 0)::DOUBLE END, 6) AS rate
FROM b JOIN w USING (user_id, bin) LEFT JOIN c USING (user_id, bin)""")
def psth_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    trials, aligned = aligned_spikes(spark, sf_dir)
    return histograms.histogram(aligned, trials, "user_id", "offset", "start", "stop", HOUR, 24).withColumn("rate", F.round("rate", 6))


@query(f"""WITH {_BASE}, n AS (SELECT user_id, count(*) n FROM tr GROUP BY 1),
h AS (SELECT user_id, CAST(round_even(o / 3600000000.0, 0) AS INT) AS bin, count(DISTINCT trial) h FROM al GROUP BY 1, 2)
SELECT user_id, bin, round(h::DOUBLE / n, 6) AS mean FROM h JOIN n USING (user_id) WHERE bin < 24""")
def psth_binary_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    trials, aligned = aligned_spikes(spark, sf_dir)
    return histograms.binary_mean(aligned, trials, "user_id", "trial", "offset", HOUR, 24).withColumn("mean", F.round("mean", 6))


@query(f"""WITH {_BASE}, num AS (SELECT trial, (row_number() OVER (PARTITION BY user_id ORDER BY s, trial) - 1) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM tr),
half AS (SELECT trial, k % 2 AS h FROM num WHERE k < n - n % 2),
c AS (SELECT h, CAST(round_even(o / 3600000000.0, 0) AS INT) AS bin, count(*) n FROM al JOIN half USING (trial) GROUP BY 1, 2),
p AS (SELECT b.i AS bin, coalesce(max(n) FILTER (h = 0), 0) a, coalesce(max(n) FILTER (h = 1), 0) z FROM range(24) b(i) LEFT JOIN c ON c.bin = b.i GROUP BY 1),
r AS (SELECT corr(a, z) r FROM p)
SELECT round(r, 6) AS r, round(1 / (1 + 2 * (1 / (r * r) - 1)), 6) AS ceiling_halves, round((2 * r / (1 - r)) / (1 + 2 * r / (1 - r)), 6) AS ceiling_snr FROM r""")
def psth_halves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Odd and even trials of each user (a last odd one is left out), binned over all users; their correlation bounds a model."""
    trials, aligned = aligned_spikes(spark, sf_dir)
    w = Window.partitionBy("user_id")
    numbered = trials.withColumn("k", F.row_number().over(w.orderBy("start", "trial")) - 1).withColumn("n", F.count("*").over(w))
    half = numbered.where("k < n - n % 2").select("trial", (F.col("k") % 2).alias("half"))
    counts = aligned.join(half, "trial").groupBy(histograms.bin_of(F.col("offset"), HOUR).alias("bin")).agg(*(F.count(F.when(F.col("half") == h, 1)).alias(f"n{h}") for h in (0, 1)))
    grid = spark.range(24).select(F.col("id").cast("int").alias("bin")).join(counts, "bin", "left").na.fill(0)
    r = F.col("r")
    return grid.agg(F.corr("n0", "n1").alias("r")).select(F.round(r, 6).alias("r"), F.round(statistics.ceiling_of_halves(r), 6).alias("ceiling_halves"), F.round(statistics.ceiling_of_snr(r), 6).alias("ceiling_snr"))


HANN_21 = sequences.hann(21)


@query(f"""WITH {_BASE}, half AS (SELECT user_id, trial, s, e, (row_number() OVER (PARTITION BY user_id ORDER BY s, trial) - 1) % 2 AS h FROM tr),
g AS (SELECT u.user_id, h.i AS h, b.i AS bin FROM (SELECT DISTINCT user_id FROM tr) u, range(2) h(i), range(24) b(i)),
c AS (SELECT al.user_id, h, CAST(round_even(o / 3600000000.0, 0) AS INT) AS bin, count(*) AS n FROM al JOIN half USING (trial) GROUP BY 1, 2, 3),
w AS (SELECT user_id, h, b.i AS bin, count(*) FILTER ((e - s) / 3600000000.0 >= b.i) AS w FROM half, range(24) b(i) GROUP BY 1, 2, 3),
p AS (SELECT user_id, h, bin, coalesce(n, 0)::DOUBLE / greatest(coalesce(w, 0), 1) AS r, coalesce(w, 0) AS w FROM g LEFT JOIN c USING (user_id, h, bin) LEFT JOIN w USING (user_id, h, bin)),
k(k, v) AS (VALUES {", ".join(f"({k}, {v!r}::DOUBLE)" for k, v in enumerate(HANN_21))}),
s AS (SELECT a.user_id, a.h, a.bin, sum(v * coalesce(b.r, 0)) AS r, any_value(a.w) AS w FROM p a CROSS JOIN k LEFT JOIN p b ON b.user_id = a.user_id AND b.h = a.h AND b.bin = a.bin + 10 - k GROUP BY 1, 2, 3),
q AS (SELECT x.r AS x, y.r AS y, x.w + y.w AS w FROM s x JOIN s y USING (user_id, bin) WHERE x.h = 0 AND y.h = 1),
qm AS (SELECT sum(w * x) / sum(w) AS mx, sum(w * y) / sum(w) AS my FROM q), r AS (SELECT sum(w * (x - mx) * (y - my)) / sqrt(sum(w * (x - mx) * (x - mx)) * sum(w * (y - my) * (y - my))) AS r FROM q, qm)
SELECT round(r, 6) AS r, round(1 / (1 + 2 * (1 / (r * r) - 1)), 6) AS ceiling FROM r""")
def ceiling_hann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates of alternate trials of each user, smoothed over 21 bins within a user, and correlated with the trials as weights: the ceiling of explained variance."""
    trials, aligned = aligned_spikes(spark, sf_dir)
    half = trials.withColumn("half", (F.row_number().over(Window.partitionBy("user_id").orderBy("start", "trial")) - 1) % 2)
    spikes = aligned.join(half.select("trial", "half"), "trial")
    grid = histograms.bin_grid(trials, "user_id", 24)
    sides = []
    for h in (0, 1):
        psth = histograms.histogram(spikes.where(F.col("half") == h), half.where(F.col("half") == h), "user_id", "offset", "start", "stop", HOUR, 24)
        filled = grid.join(psth, ["user_id", "bin"], "left").na.fill(0)
        sides.append(sequences.smooth(filled, "user_id", "bin", "rate", HANN_21).select("user_id", "bin", F.col("smooth").alias(f"r{h}"), F.col("weight").alias(f"w{h}")))
    both = sides[0].join(sides[1], ["user_id", "bin"])
    r = both.agg(statistics.weighted_moments(F.col("r0"), F.col("r1"), F.col("w0") + F.col("w1"))["corr_xy"].alias("r"))
    return r.select(F.round("r", 6).alias("r"), F.round(statistics.ceiling_of_halves(F.col("r")), 6).alias("ceiling"))


@query("""WITH iv AS (SELECT user_id, epoch_us(min(ts)) AS a, epoch_us(max(ts)) AS z FROM events WHERE event_type IN ('signup', 'purchase') GROUP BY 1)
SELECT event_id, user_id FROM events e WHERE event_type = 'view' AND EXISTS (SELECT 1 FROM iv WHERE iv.user_id = e.user_id AND a < epoch_us(e.ts) AND z > epoch_us(e.ts) + 3600000000)""")
def interval_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = micros(table(spark, sf_dir, "events"))
    spans = e.where("event_type in ('signup', 'purchase')").groupBy("user_id").agg(F.min("t").alias("a"), F.max("t").alias("z"))
    views = e.where("event_type = 'view'").select("event_id", "user_id", F.col("t").alias("start"), (F.col("t") + HOUR).alias("stop"))
    return intervals.contained(views, spans, "user_id", "start", "stop", "a", "z", DAY).select("event_id", "user_id")


RUN_OF_HOURS = 4096


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(band, t, n): events of each type in each hour of the table's span, zeros included."""
    e = micros(table(spark, sf_dir, "events")).select(F.col("event_type").alias("band"), F.floor(F.col("t") / HOUR).alias("h"))
    counts = e.groupBy("band", "h").agg(F.count("*").alias("n"))
    ends = counts.agg(F.min("h").alias("a"), F.max("h").alias("z"))
    # Each band gets the span's ends, then its runs of hours, dealt out, and in a run its hours.
    spans = counts.select("band").distinct().crossJoin(F.broadcast(ends))  # one row
    runs = spans.select("band", "a", "z", F.explode(F.sequence("a", "z", F.lit(RUN_OF_HOURS))).alias("from")).repartition("band", "from")
    grid = runs.select("band", "a", F.explode(F.sequence("from", F.least(F.col("from") + RUN_OF_HOURS - 1, "z"))).alias("h"))
    return grid.join(counts, ["band", "h"], "left").select("band", (F.col("h") - F.col("a")).alias("t"), F.coalesce("n", F.lit(0)).alias("n"))


HOURLY_SQL = """hc AS (SELECT event_type AS band, epoch_us(ts) // 3600000000 AS h, count(*) AS n FROM events GROUP BY 1, 2),
hb AS (SELECT min(h) a, max(h) z FROM hc),
hourly AS (SELECT b.band, (r.h - a)::BIGINT AS t, coalesce(n, 0)::BIGINT AS n FROM (SELECT DISTINCT band FROM hc) b, hb, unnest(range(a, z + 1)) r(h) LEFT JOIN hc ON hc.band = b.band AND hc.h = r.h)"""


@query(f"""WITH {HOURLY_SQL}, s AS (SELECT band, t, (n <= 1)::INT AS quiet FROM hourly),
i AS (SELECT band, t, row_number() OVER (PARTITION BY band ORDER BY t) - row_number() OVER (PARTITION BY band, quiet ORDER BY t) AS g, quiet FROM s)
SELECT band, min(t) AS start, max(t) + 1 AS stop FROM i WHERE quiet = 1 GROUP BY band, g HAVING count(*) > 2""")
def zero_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of more than two quiet hours (at most one event) by band."""
    quiet = hourly(spark, sf_dir).withColumn("loud", F.when(F.col("n") <= 1, 0).otherwise(F.col("n")))
    return intervals.long_runs(quiet, "band", "t", "loud", 2)


@query(f"""WITH {HOURLY_SQL}, s AS (SELECT band, t, n, (n <= 1)::INT AS quiet FROM hourly),
i AS (SELECT band, t, row_number() OVER (PARTITION BY band ORDER BY t) - row_number() OVER (PARTITION BY band, quiet ORDER BY t) AS g, quiet FROM s),
r AS (SELECT band, min(t) AS a, max(t) + 1 AS z FROM i WHERE quiet = 1 GROUP BY band, g HAVING count(*) > 2)
SELECT band, t, CASE WHEN EXISTS (SELECT 1 FROM r WHERE r.band = s.band AND s.t BETWEEN a AND z) THEN 0 ELSE 1 END AS weight FROM s""")
def masked_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    series = hourly(spark, sf_dir)
    quiet = series.withColumn("loud", F.when(F.col("n") <= 1, 0).otherwise(F.col("n")))
    runs = intervals.long_runs(quiet, "band", "t", "loud", 2)
    return intervals.masked(series.withColumn("weight", F.lit(1)), runs, "band", "t", "weight").select("band", "t", "weight")


@query("""WITH e AS (SELECT event_id, user_id, epoch_us(ts) AS t FROM events),
g AS (SELECT *, coalesce(t - lag(t + 60000000) OVER (PARTITION BY user_id ORDER BY t, event_id), 0) AS gap FROM e),
s AS (SELECT *, sum((gap > 21600000000)::INT) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS session FROM g)
SELECT user_id, session, min(t) AS first_t, max(t + 60000000) AS last_t, count(*) AS n FROM s GROUP BY 1, 2""")
def sessionize_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of a user's events, each a minute long, parted by more than six hours from end to start."""
    e = micros(table(spark, sf_dir, "events")).select("event_id", "user_id", "t", (F.col("t") + 60_000_000).alias("end"))
    s = intervals.sessions(e, "user_id", "t", "end", 6 * HOUR, ["event_id"])
    return s.groupBy("user_id", "session").agg(F.min("t").alias("first_t"), F.max("end").alias("last_t"), F.count("*").alias("n"))


@query(f"""WITH {HOURLY_SQL}, ev AS (SELECT band, t FROM hourly WHERE n > 5), f AS (SELECT ev.band, ev.t, l.i AS lag, coalesce(h.n, 0) AS n FROM ev, range(10) l(i) LEFT JOIN hourly h ON h.band = ev.band AND h.t = ev.t + l.i - 3),
m AS (SELECT band, avg(n) AS g FROM hourly GROUP BY 1) SELECT band, lag::INT AS lag, round(avg(n) - any_value(g), 6) AS evoked, count(*) AS n_events FROM f JOIN m USING (band) GROUP BY band, lag""")
def event_window_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean counts about busy hours (more than five events) less the band's mean."""
    frames = hourly(spark, sf_dir)
    cells = intervals.windows_at(frames.where("n > 5").select("band", "t"), frames, "band", "t", "n", 3, 10)
    means = frames.groupBy("band").agg(F.avg("n").alias("g"))
    out = cells.groupBy("band", "lag").agg(F.avg("n").alias("m"), F.count("*").alias("n_events")).join(means, "band")
    return out.select("band", "lag", F.round(F.col("m") - F.col("g"), 6).alias("evoked"), "n_events")


@query("""WITH s AS (SELECT user_id, count(*) AS size FROM events GROUP BY 1), m AS (SELECT min(size) AS small FROM s), k AS (SELECT user_id, greatest(small, 7) AS take FROM s, m WHERE small >= 7 OR size > 6),
r AS (SELECT event_id, user_id, take, row_number() OVER (PARTITION BY user_id ORDER BY md5(event_id::VARCHAR || ':7')) AS rn FROM events JOIN k USING (user_id)) SELECT event_id, user_id FROM r WHERE rn <= take""")
def balance_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "user_id")
    return intervals.balanced(e, "user_id", F.md5(F.concat(F.col("event_id").cast("string"), F.lit(":7"))), 7, 6)


@query("""SELECT event_type, user_id, k, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT event_type, user_id, value, CAST(props->>'k' AS INT) AS k FROM events) GROUP BY ALL""")
def json_covariate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A covariate from the JSON column, grouped with type and unit."""
    e = table(spark, sf_dir, "events").withColumn("k", F.from_json("props", "k int")["k"])
    return e.groupBy("event_type", "user_id", "k").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
