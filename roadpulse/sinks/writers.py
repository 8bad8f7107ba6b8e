"""Where results go: files, tables, topics, and a fallback when the first place fails.

A batch writer is called as ``writer(batch, batch_id)``. The file writers put
each batch in a folder of its own and overwrite it when the batch is repeated,
so a restart leaves no doubles.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadpulse.operators.anomalies import encode_json
from roadpulse.schemas import ANOMALY_TABLE_COLUMNS, TRIGGER

BatchWriter = Callable[[DataFrame, int], None]
log = logging.getLogger(__name__)


def anomaly_table_rows(anomalies: DataFrame) -> DataFrame:
    """Anomalies as rows of the SQL table: values as text, time of writing, day of the signal."""
    return anomalies.select(
        "*",
        F.col("kafka_ts").alias("kafka_timestamp"),
        F.col("sig_ts").alias("sig_timestamp"),
        F.current_timestamp().alias("created_at"),
        F.to_date(F.timestamp_millis("sig_ts")).alias("event_date"),
    ).select(*ANOMALY_TABLE_COLUMNS)


def json_batches(path: str) -> BatchWriter:
    """Anomalies as JSON lines, the form they have on a queue."""

    def write(batch: DataFrame, batch_id: int) -> None:
        encode_json(batch).select("value").write.mode("overwrite").text(f"{path}/batch_id={batch_id}")

    return write


def table_batches(path: str) -> BatchWriter:
    """Anomalies as table rows, by day, sorted by vehicle within a file."""

    def write(batch: DataFrame, batch_id: int) -> None:
        (
            anomaly_table_rows(batch).hint("rebalance", "event_date")
            .sortWithinPartitions("event_date", "vin")
            .write.mode("overwrite").partitionBy("event_date").parquet(f"{path}/batch_id={batch_id}")
        )

    return write


def kafka_batches(servers: str, topic: str) -> BatchWriter:
    """Anomalies as messages keyed by vehicle. A repeated batch is sent again (at least once)."""

    def write(batch: DataFrame, batch_id: int) -> None:
        (
            encode_json(batch).select(F.col("vin").alias("key"), "value")
            .write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).save()
        )

    return write


def jdbc_batches(url: str, table: str, properties: Mapping[str, str]) -> BatchWriter:
    """Anomalies as rows of a database table. A repeated batch is inserted again (at least once)."""

    def write(batch: DataFrame, batch_id: int) -> None:
        anomaly_table_rows(batch).drop("event_date").write.mode("append").jdbc(
            url, table, properties=dict(properties)
        )

    return write


def two_tier(primary: BatchWriter, fallback: BatchWriter) -> BatchWriter:
    """Write to ``primary``; if that fails write the same batch to ``fallback``.

    If both fail the error is raised, so the batch is not committed and is tried
    again: nothing is lost. A batch that moved from one to the other between
    tries may be in both; rows are unique by (vin, seq, anomaly_type).
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            try:
                primary(batch, batch_id)
            except Exception:
                log.exception("batch %s: first sink failed, using the fallback", batch_id)
                fallback(batch, batch_id)
        finally:
            batch.unpersist()

    return write


def append_anomalies(anomalies: DataFrame, table: str) -> None:
    """Append to a catalog table, made on first use, by day and sorted by vehicle."""
    (
        anomaly_table_rows(anomalies).hint("rebalance", "event_date")
        .sortWithinPartitions("event_date", "vin")
        .write.mode("append").partitionBy("event_date").saveAsTable(table)
    )


def encode_triggers(routed: DataFrame) -> DataFrame:
    """route and JSON text of each trigger, fields in record order, nulls kept."""
    fields = F.struct(*[F.col(f.name) for f in TRIGGER.fields])
    return routed.select(
        "route", "vin", F.to_json(fields, {"ignoreNullFields": "false"}).alias("value")
    )


def decode_triggers(messages: DataFrame) -> DataFrame:
    """Back from JSON text to trigger columns."""
    return messages.select("route", F.from_json("value", TRIGGER).alias("t")).select("route", "t.*")


def write_routes(routed: DataFrame, path: str, mode: str = "append") -> None:
    """Triggers as JSON lines, one folder per route."""
    encode_triggers(routed).drop("vin").write.mode(mode).partitionBy("route").text(path)


def read_route(spark, path: str, route: str) -> DataFrame:
    """Triggers waiting on one route; other routes' folders are not read."""
    return decode_triggers(spark.read.text(path).where(F.col("route") == route))


def send_routes(routed: DataFrame, servers: str) -> None:
    """Triggers to Kafka, each to the topic named after its route."""
    (
        encode_triggers(routed)
        .select(F.col("route").alias("topic"), F.col("vin").alias("key"), "value")
        .write.format("kafka").option("kafka.bootstrap.servers", servers).save()
    )


def append_rows(rows: DataFrame, path: str) -> None:
    """Append fact rows, step events or alerts, with the time of writing, by day of writing."""
    (
        rows.withColumn("created_at", F.current_timestamp())
        .withColumn("created_date", F.current_date())
        .write.mode("append").partitionBy("created_date").parquet(path)
    )


def row_batches(path: str) -> BatchWriter:
    """Fact rows, step events or alerts of a stream."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("created_at", F.current_timestamp()).write.mode("overwrite").parquet(
            f"{path}/batch_id={batch_id}"
        )

    return write
