"""Gapless places of rows in a global order, without one task that sees them all."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadpulse.llm.common import saved


def placed(rows: DataFrame, key: str, order: list[str], purpose: str) -> DataFrame:
    """Add ``place`` (from 0 within each ``key``, in ``order``) and ``n`` (rows of the key).

    The rows are cut into ranges of (key, order) and written. A range knows the places of its own rows; how many rows of
    a key lie in earlier ranges is a running sum over one row per key and range. So a key with a third of all rows
    is spread over a third of the ranges. ``key`` must not be null. Rows equal in key and order have any order among them.
    """
    ranged = rows.repartitionByRange(key, *order).withColumn("_range", F.spark_partition_id())
    ranged = saved(ranged, purpose)
    by_key = Window.partitionBy("_k").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranged.groupBy(F.col(key).alias("_k"), F.col("_range").alias("_r")).agg(F.count("*").alias("_c"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_c").over(by_key), F.lit(0))).withColumn(
        "n", F.sum("_c").over(Window.partitionBy("_k"))).drop("_c")
    inside = F.row_number().over(Window.partitionBy(key, "_range").orderBy(*order)) - 1
    numbered = ranged.withColumn("_inside", inside)
    return numbered.join(before, (numbered[key] == before["_k"]) & (numbered["_range"] == before["_r"])).withColumn("place", F.col("_before") + F.col("_inside")).drop(
        "_k", "_r", "_before", "_inside", "_range")

