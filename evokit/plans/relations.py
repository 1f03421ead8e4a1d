"""Queries on joins, filters, sets, encoders and samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evokit.catalog import query
from evokit.functions import scalars
from evokit.operators import encoders, intervals
from evokit.session import table


@query("SELECT o_orderkey, o_custkey, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F' GROUP BY 1, 2")
def pair_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stimulus and response by number: an equi-join with the filter and columns pushed to the scans."""
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select("o_orderkey", "o_custkey")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity")
    return o.join(lines, o.o_orderkey == lines.l_orderkey).groupBy("o_orderkey", "o_custkey").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("SELECT o_orderkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o.o_orderkey AND l_quantity > 45)")
def unmatched_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return intervals.unmatched(table(spark, sf_dir, "orders").select("o_orderkey"), lines, ["o_orderkey"])


@query("SELECT r_name, n_name, count(*) AS customers, round(avg(c_acctbal), 4) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2")
def natural_join_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("n_nationkey"), "c_acctbal")
    n = table(spark, sf_dir, "nation").withColumnRenamed("n_regionkey", "r_regionkey")
    return c.join(n, "n_nationkey").join(table(spark, sf_dir, "region"), "r_regionkey").groupBy("r_name", "n_name").agg(F.count("*").alias("customers"), F.round(F.avg("c_acctbal"), 4).alias("balance"))


@query("SELECT event_id, round(CASE WHEN value > 0 THEN greatest(0.0::DOUBLE, 20 * log10(value / (SELECT max(value) FROM events)) + 80) ELSE 0.0 END, 6) AS level FROM events")
def threshold_db(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values in decibels below the table's largest, floored: the maximum is one row that is broadcast."""
    e = table(spark, sf_dir, "events").select("event_id", "value")
    largest = e.agg(F.max("value").alias("largest"))
    return e.crossJoin(F.broadcast(largest)).select("event_id", F.round(scalars.decibels(F.col("value"), F.col("largest")), 6).alias("level"))  # one row


@query("""WITH c AS (SELECT DISTINCT role FROM conversations WHERE role IS NOT NULL), k AS (SELECT role, (row_number() OVER (ORDER BY role) - 1)::INT AS code FROM c)
SELECT conv_id, turn, code FROM conversations JOIN k USING (role)""")
def label_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    return c.join(encoders.label_codes(c, "role"), "role").select("conv_id", "turn", "code")


@query("""WITH t AS (SELECT source, row_number() OVER (ORDER BY count(*) DESC, source) AS r FROM documents GROUP BY 1 ORDER BY r LIMIT 3)
SELECT doc_id, (coalesce(r, 0) = 1)::INT AS hot_1, (coalesce(r, 0) = 2)::INT AS hot_2, (coalesce(r, 0) = 3)::INT AS hot_3, (r IS NULL)::INT AS hot_rest FROM documents LEFT JOIN t USING (source)""")
def topk_onehot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoders.one_hot_top(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", 3).drop("source")


@query("""WITH x AS (SELECT conv_id, turn, max(turn) OVER (PARTITION BY conv_id) AS l FROM conversations)
SELECT conv_id, turn, CASE WHEN l >= 5 AND turn = l - 2 THEN 3 WHEN l >= 4 AND turn = l - 1 THEN 4 WHEN l >= 3 AND turn = 2 THEN 2 WHEN l >= 2 AND turn = 1 THEN 1 WHEN l >= 1 AND turn = l THEN 5 ELSE 0 END AS place FROM x""")
def sentence_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as sentences: the place of each turn. The last turn is an aggregate, joined back, so a long conversation is not sorted in one task."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn")
    last = c.groupBy("conv_id").agg(F.max("turn").alias("last"))
    return c.join(last, "conv_id").select("conv_id", "turn", scalars.sentence_position(F.col("turn"), F.col("last")).alias("place"))


@query("""WITH s AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1), r AS (SELECT conv_id, n, sum(n) OVER (ORDER BY md5(conv_id::VARCHAR || ':0'), conv_id) - n AS before, sum(n) OVER () AS total FROM s)
SELECT conv_id, n, before < 0.2::DOUBLE * total AS held_out FROM r""")
def train_test_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole conversations in hashed order go to the test set until it has a fifth of the turns.

    The running total is over ordered ranges: totals of hash prefixes first, then within a prefix.
    """
    s = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("n")).withColumn("h", F.md5(F.concat(F.col("conv_id").cast("string"), F.lit(":0"))))
    s = s.withColumn("prefix", F.substring("h", 1, 3))
    totals = s.groupBy("prefix").agg(F.sum("n").alias("m"))  # 4096 rows at most
    w = Window.orderBy("prefix")
    totals = totals.select("prefix", (F.sum("m").over(w) - F.col("m")).alias("ahead"), F.sum("m").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("total"))
    within = F.sum("n").over(Window.partitionBy("prefix").orderBy("h", "conv_id")) - F.col("n")
    return s.join(F.broadcast(totals), "prefix").select("conv_id", "n", (within + F.col("ahead") < F.lit(0.2) * F.col("total")).alias("held_out"))


@query("""SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT' INTERSECT SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R'""")
def set_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select("o_orderkey")
    return a.intersect(table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")))


@query("""SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT' EXCEPT SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R'""")
def set_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select("o_orderkey")
    return a.subtract(table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")))


@query("SELECT c_custkey AS k, c_nationkey AS nation, 'customer' AS kind FROM customer UNION ALL SELECT s_suppkey, s_nationkey, 'supplier' FROM supplier")
def union_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("nation"), F.lit("customer").alias("kind"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("nation"), F.lit("supplier").alias("kind"))
    return c.unionByName(s)


@query("SELECT source, count(*) AS n FROM documents GROUP BY 1 ORDER BY n DESC, source LIMIT 10")
def value_counts_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoders.top_values(table(spark, sf_dir, "documents"), "source", 10).select("source", "n")


@query("SELECT o_orderkey, md5(concat_ws('|', o_orderkey::VARCHAR, o_custkey::VARCHAR, o_orderstatus, o_orderpriority)) AS fingerprint, sha256(o_orderpriority) AS kind FROM orders")
def checksum(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", F.md5(F.concat_ws("|", F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string"), "o_orderstatus", "o_orderpriority")).alias("fingerprint"), F.sha2("o_orderpriority", 256).alias("kind"))


@query("""WITH x AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS d FROM embeddings),
r AS (SELECT vec_id, d, v, row_number() OVER (PARTITION BY vec_id ORDER BY abs(v) DESC, d) AS rn FROM x) SELECT vec_id, d::INT AS d, v FROM r WHERE rn <= 5""")
def top_coeffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five largest coefficients of each vector, chosen within its array."""
    by = F.array_sort(F.transform("embedding", lambda v, i: F.struct((-F.abs(v.cast("double"))).alias("o"), (i + 1).alias("d"), v.cast("double").alias("v"))))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.explode(F.slice(by, 1, 5)).alias("x")).select("vec_id", F.col("x.d").cast("int").alias("d"), "x.v")


@query("""SELECT p.i::INT AS px, d.i::INT AS dir, s.i::INT AS sf, round(cos(pi() * d.i / 4) * (s.i + 1), 6) + 0.0 AS kx, round(sin(pi() * d.i / 4) * (s.i + 1), 6) + 0.0 AS ky FROM range(4) p(i), range(8) d(i), range(3) s(i)""")
def gabor_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parameter grid of a Gabor bank: a product of three short ranges."""
    axis = lambda n, c: spark.range(n).select(F.col("id").cast("int").alias(c))
    g = axis(4, "px").crossJoin(axis(8, "dir")).crossJoin(axis(3, "sf"))
    angle = F.pi() * F.col("dir") / 4
    return g.select("*", (F.round(F.cos(angle) * (F.col("sf") + 1), 6) + F.lit(0.0)).alias("kx"), (F.round(F.sin(angle) * (F.col("sf") + 1), 6) + F.lit(0.0)).alias("ky"))
