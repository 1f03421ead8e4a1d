"""Writers of models, statistics and configurations, through Spark's commit protocol."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def models(rows: DataFrame, path: str, by: str = "tol") -> None:
    """Coefficients in one folder a value of ``by``."""
    rows.write.partitionBy(by).mode("overwrite").parquet(path)


def csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").csv(path, header=True)


def electrode_configs(spark: SparkSession, path: str, electrodes: int, settings: dict[str, object]) -> None:
    """One JSON row an electrode, with the settings in each."""
    rows = spark.range(1, electrodes + 1).select(F.col("id").cast("int").alias("electrode_num"), *(F.lit(v).alias(k) for k, v in settings.items()))
    rows.write.mode("overwrite").json(path)
