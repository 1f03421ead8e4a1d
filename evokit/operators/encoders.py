"""Categories as numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def label_codes(rows: DataFrame, column: str, most: int = 1_000_000) -> DataFrame:
    """(column, code): codes by order of the distinct values, which must be at most ``most``."""
    values = rows.select(column).where(F.col(column).isNotNull()).distinct()
    if values.limit(most + 1).count() > most:
        raise ValueError(f"{column} has over {most} values")
    return values.withColumn("code", F.row_number().over(Window.orderBy(column)) - 1)


def top_values(rows: DataFrame, column: str, k: int) -> DataFrame:
    """(column, n, rank) of the k most frequent values; ties by value."""
    counts = rows.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(k)
    return counts.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), column)))


def one_hot_top(rows: DataFrame, column: str, k: int) -> DataFrame:
    """Adds hot_1..hot_k for the most frequent values and hot_rest."""
    top = F.broadcast(top_values(rows, column, k).select(column, "rank"))  # k rows
    joined = rows.join(top, column, "left")
    flags = {f"hot_{i}": (F.coalesce("rank", F.lit(0)) == i).cast("int") for i in range(1, k + 1)}
    return joined.withColumns(flags | {"hot_rest": F.col("rank").isNull().cast("int")}).drop("rank")
