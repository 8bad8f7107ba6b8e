"""Dimension, definition and process tables, from files or over JDBC."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadpulse.schemas import CAR_USER_INFO, SIGNAL_DEF


def read_usage(spark: SparkSession, path: str) -> DataFrame:
    """Usage assignments: id, vin, use_type and create_ms (epoch ms)."""
    return usage_rows(spark.read.schema(CAR_USER_INFO).parquet(path))


def read_usage_jdbc(
    spark: SparkSession, url: str, properties: Mapping[str, str],
    table: str = "car_user_info", partitions: int = 16,
) -> DataFrame:
    """The same from a database, read in ``partitions`` ranges of the ids it holds."""
    held = f"(select min(id) as low, max(id) as high from {table}) as ids"
    low, high = spark.read.jdbc(url, held, properties=dict(properties)).first()
    if low is None:
        low, high = 0, 1
    return usage_rows(
        spark.read.jdbc(url, table, column="id", lowerBound=low, upperBound=high,
                        numPartitions=partitions, properties=dict(properties))
    )


def usage_rows(table: DataFrame) -> DataFrame:
    return table.select("id", "vin", "use_type", F.unix_millis("create_at").alias("create_ms"))


def read_signal_defs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SIGNAL_DEF).parquet(path)
