"""Helpers that several operators share."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from roadpulse.session import shared_dir

# What the contracts call a space: blank, tab, line feed, vertical tab, form feed, carriage return.
SPACE = "\\x20\\x09-\\x0D"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z, all else unchanged."""
    return F.translate(text, UPPER, LOWER)


def saved(df: DataFrame, purpose: str) -> DataFrame:
    """Write a table to the shared folder and read it back.

    This cuts the lineage: what was worked out is not worked out again, whoever is lost.
    """
    path = shared_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def slices(batches: Iterable[pa.RecordBatch], column: str = "text",
           most_bytes: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches by bytes of text, so that a task's memory follows no row count.

    A single text above the bound makes a slice of its own.
    """
    for batch in batches:
        if batch.num_rows == 0:
            continue
        size = batch.column(column).nbytes
        rows = max(1, batch.num_rows * most_bytes // max(size, 1))
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts of a batch, null as the empty text."""
    return [t or "" for t in batch.column(column).to_pylist()]


def bounded_sample(df: DataFrame, rows: int, by: Column, group: str | None = None, prefer: Column | None = None) -> DataFrame:
    """At most ``rows`` rows, those with the smallest hash ``by``; of each value of ``group``, null apart, if given.

    A group with rows where ``prefer`` holds gives only those. The counts come first. Then a first cut by hash, which
    is a filter of the scan, keeps about twice as many rows, so that only those move and are sorted, whatever the table
    holds. The counts of the groups go to the tasks, a row for each.
    """
    hashed = df.withColumn("_h", by).withColumn("_prefer", F.lit(True) if prefer is None else F.coalesce(prefer, F.lit(False)))
    n = [F.count_if("_prefer").alias("_liked"), F.count("*").alias("_all")]
    if group:
        counted = hashed.groupBy(F.col(group).alias("_group")).agg(*n)
        hashed = hashed.join(F.broadcast(counted), F.col(group) == F.col("_group"))
    else:
        liked, total = hashed.agg(*n).first()
        if not total:
            return df.limit(0)
        hashed = hashed.withColumns({"_liked": F.lit(liked), "_all": F.lit(total)})
    share = 2.0 * rows / F.when(F.col("_liked") > 0, F.col("_liked")).otherwise(F.col("_all"))
    near = hashed.where((F.col("_prefer") | (F.col("_liked") == 0)) & (
        F.pmod("_h", F.lit(1 << 30)) / F.lit(float(1 << 30)) < share))
    place = F.row_number().over(Window.partitionBy(F.col(group) if group else F.lit(0)).orderBy("_h"))
    return near.withColumn("_place", place).where(F.col("_place") <= rows).select(*df.columns)


def ddl(df: DataFrame) -> str:
    """The columns of a table as a schema text."""
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
