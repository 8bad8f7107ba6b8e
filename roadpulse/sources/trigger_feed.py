"""Landed pages of the trigger feed and file manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roadpulse.schemas import FILE_MANIFEST, TRIGGER_PAGE


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """All landed pages below ``path``, one JSON document per line."""
    return spark.read.schema(TRIGGER_PAGE).json(path)


def stream_pages(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    """Pages as they land; ``max_files`` bounds a micro-batch."""
    return (
        spark.readStream.schema(TRIGGER_PAGE).option("maxFilesPerTrigger", max_files).json(path)
    )


def read_manifests(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FILE_MANIFEST).json(path)


def records(pages: DataFrame) -> DataFrame:
    """One row per record of the pages."""
    return pages.select(F.explode("data").alias("r")).select("r.*")


def can_file_url(file_info: Column) -> Column:
    """Address of the first CAN file; null if there is none."""
    return F.get(F.filter(file_info, lambda f: f.file_type == "can"), 0).file_url


def select_can_file(manifests: DataFrame, *keep: str) -> DataFrame:
    """vin, timestamp and CAN file address of each manifest; ``error`` is set where none is listed."""
    url = can_file_url(F.col("data.file_info"))
    return manifests.select(
        *keep, "data.vin", "data.timestamp", url.alias("file_url"),
        F.when(F.coalesce(url, F.lit("")) == "", "no_can_file").alias("error"),
    )
