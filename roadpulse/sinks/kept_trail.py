"""Process logs kept up to date: new step events are merged into a stored table of folded logs.

The table is partitioned by a hash of the log's id. An increment reads and rewrites only the partitions that its logs
are in, so its cost follows the increment and the partitions it meets, not the history. A log is kept as its steps in order,
each step once: merging the same events again changes nothing, so a repeated increment does no harm.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadpulse.session import has_files

KEPT = "log_id bigint, steps array<struct<step:bigint,name:string>>, known boolean, part int"
PARTS = 64


def _folded(steps: DataFrame) -> DataFrame:
    """Per log its steps in order, each once (of several events of one step the first name), and whether it has an insert."""
    once = steps.groupBy("log_id", "step").agg(F.min("name").alias("name"), F.max("known").alias("known"))
    return once.groupBy("log_id").agg(
        F.array_sort(F.collect_list(F.struct("step", "name"))).alias("steps"), F.max("known").alias("known"))


def merge_steps(steps: DataFrame, path: str, parts: int = PARTS) -> None:
    """Merge step events (log_id, step, name, is_insert) into the table at ``path``, made on first use with ``parts``.

    ``parts`` must stay what it was; choose it so that a partition is a task's work when the table is full.
    """
    spark = steps.sparkSession
    part = F.pmod(F.xxhash64("log_id"), F.lit(parts)).cast("int")
    new = steps.select("log_id", F.col("step").cast("bigint").alias("step"), "name", F.col("is_insert").alias("known"))
    fresh = _folded(new).withColumn("part", part).persist()
    try:
        met = [r.part for r in fresh.select("part").distinct().collect()]  # at most ``parts`` numbers
        if not met:
            return
        rows = fresh.drop("part")
        if has_files(spark, path):
            rows = rows.unionByName(read_kept(spark, path).where(F.col("part").isin(met)).drop("part"))
        each = rows.select("log_id", F.explode("steps").alias("s"), "known").select("log_id", "s.step", "s.name", "known")
        merged = _folded(each).withColumn("part", part)
        (
            merged.repartition("part").sortWithinPartitions("part", "log_id")
            .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path)
        )
    finally:
        fresh.unpersist()


def read_kept(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(KEPT).parquet(path)


def kept_trails(spark: SparkSession, path: str) -> DataFrame:
    """The trails of all kept logs, as ``operations.process_trail`` folds them: log_id, process_log, process_status, n_steps."""
    return read_kept(spark, path).select(
        "log_id",
        F.array_join(F.transform("steps", lambda s: s["name"]), " -> ").alias("process_log"),
        F.element_at("steps", -1)["name"].alias("process_status"),
        F.size("steps").cast("bigint").alias("n_steps"),
    )


def kept_orphans(spark: SparkSession, path: str) -> DataFrame:
    """Kept logs with updates but no insert, and how many updates."""
    return read_kept(spark, path).where("not known").select("log_id", F.size("steps").cast("bigint").alias("n_updates"))
