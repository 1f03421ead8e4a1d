"""Queries of the operators over whole tables, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evokit.llm import byte_bpe, chat_format, decontaminate, fill_middle, hard_negatives, jaccard_join, main_text, ordinal_quality, quality_rules, secret_scan, sql, token_files, url_filter, warc
from evokit.session import scratch_path, table


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return byte_bpe.round_trip_digests(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = url_filter.fit(url_filter.labelled_urls(spark))
    return url_filter.judge(table(spark, sf_dir, "pages"), model)


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-files")
    token_files.write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), end_id=0)
    return token_files.document_checksums(spark, path)


def op3_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades: 0 unsound, 1 sound but toxic, 2 sound; a document is kept if it is sound with probability 1/2 or more."""
    docs = table(spark, sf_dir, "documents")
    grade = F.col("quality") * (2 - F.col("toxic"))
    return ordinal_quality.score(docs, ordinal_quality.fit(docs, table(spark, sf_dir, "labels"), grade, 3), grade=1)


def op4_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.extract(table(spark, sf_dir, "pages"))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.format_chats(table(spark, sf_dir, "conversations"))


def woven_calls(turns: DataFrame) -> DataFrame:
    """Conversations as agents: each assistant turn k calls tools as c<k> (after c<k - 2>), d<k> (after that and c<k>) and e, user turns answer c<k - 1>, or nothing in every seventh."""
    k = F.col("turn")
    name = lambda x, i: F.concat(F.lit(x), i.cast("string"))
    before = F.when(k >= 2, F.array(name("c", k - 2))).otherwise(F.array().cast("array<string>"))
    call = lambda i, tool, arguments, after: F.to_json(F.struct(after.alias("after"), arguments.alias("arguments"), i.alias("id"), F.lit(tool).alias("name")))
    none = F.array().cast("array<string>")
    calls = [
        call(name("c", k), "search", F.struct((k % 4).alias("limit"), F.col("text").alias("query")), before),
        call(name("d", k), "weather", F.struct(F.col("role").alias("city"), (k / 2).alias("days"), k.alias("hours")), F.concat(before, F.array(name("c", k)))),
        call(F.lit("e"), "calculate", F.struct(k.alias("expression")), none),
    ]
    said = F.regexp_replace(F.to_json(F.struct(F.col("text").alias("content"))), r"\}$", "")
    asked = F.concat(F.lit(" "), said, F.lit(',"tool_calls":['), F.concat_ws(",", *calls), F.lit("]}"))
    answer = F.to_json(F.struct(F.col("text").alias("content"), F.when(k % 7 == 3, "none").otherwise(name("c", k - 1)).alias("tool_call_id")))
    text = F.when(F.col("role") == "assistant", asked).when((F.col("role") == "user") & (k > 0), answer).otherwise(F.col("text"))
    role = F.when((F.col("role") == "user") & (k > 0), "tool").otherwise(F.col("role"))
    return turns.where("text is not null and turn is not null").select("conv_id", "turn", role.alias("role"), text.alias("text"))


def chat_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 6 on the same table with tool calls woven in, as the table has none."""
    return chat_format.format_chats(woven_calls(table(spark, sf_dir, "conversations")))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digests(table(spark, sf_dir, "documents"))


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record as it is read back from the archives."""
    path = scratch_path(spark, "warc")
    warc.write(table(spark, sf_dir, "pages"), path)
    return warc.describe(spark, path).drop("url")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors are the rows whose id is divisible by 50; every seventh label is moved on by one."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(table(spark, sf_dir, "embeddings").withColumn("label", moved), F.col("id") % 50 == 0)


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.digests(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (op1_byte_bpe, op2_url_filter, op3_ordinal_quality, op4_main_text, op5_token_files, op6_chat_format, op7_decontaminate, op8_jaccard_join, op9_quality_rules, op10_secret_scan, op11_warc, op12_hard_negatives, op13_fill_middle)
    return {f.__name__: f for f in (*every, chat_calls)}


def oracle_sql() -> dict[str, str]:
    return {"op6_chat_format": sql.CHAT_FORMAT, "chat_calls": sql.CHAT_CALLS, "op7_decontaminate": sql.CONTAMINATED, "op8_jaccard_join": sql.JACCARD_JOIN, "op9_quality_rules": sql.QUALITY_RULES, "op11_warc": sql.WARC, "op12_hard_negatives": sql.HARD_NEGATIVES, "op13_fill_middle": sql.FILL_MIDDLE}
