"""The queue depth check on schedule: a balance of pushes and pops per queue, kept from batch to batch."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from roadpulse import rules
from roadpulse.functions.literals import literal_table
from roadpulse.operators.operations import backlog_alerts
from roadpulse.session import newest_part
from roadpulse.sinks.writers import BatchWriter
from roadpulse.streaming.run import POLL_EVERY, start

# Fixed value: time between two checks.
TICK_MS = 300_000
DEPTHS = "tick bigint, route string, depth bigint"


def net_moves(moves: DataFrame, tick_ms: int = TICK_MS, delay: str = "1 minute") -> DataFrame:
    """Rows (route, delta, ts in epoch ms) to the sum of ``delta`` per tick and queue, once the watermark has passed the tick.

    A queue with most of the moves is summed before the shuffle.
    """
    timed = moves.withColumn("_at", F.timestamp_millis("ts")).withWatermark("_at", delay)
    return timed.groupBy(F.window("_at", f"{tick_ms} milliseconds").alias("w"), "route").agg(
        F.sum("delta").alias("net")).select((F.unix_millis("w.start") / tick_ms).cast("bigint").alias("tick"), "route", "net")


def depth_batches(path: str, queues: Sequence[str] = tuple(rules.QUEUES), limit: int = rules.BACKLOG_LIMIT) -> BatchWriter:
    """From the ticks that a batch closes to depths and alerts below ``path``, every listed queue at every tick.

    ``depth`` has a folder per batch with the depth of each queue at the end of each tick, ``alerts`` the messages of
    those that are too long. The next batch goes on from the newest tick of the newest folder before its own, and a
    repeated batch overwrites what it wrote, so the balance counts each move once. A tick without moves between two others
    has the depth of the one before it.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch.persist()
        try:
            low, high = batch.agg(F.min("tick"), F.max("tick")).first()
            if high is None:
                return
            listed = literal_table(spark, [(q,) for q in queues], "route string")
            before = newest_part(spark, f"{path}/depth", "batch_id", batch_id)
            if before is None:
                kept = listed.select(F.lit(low - 1).cast("bigint").alias("tick"), "route", F.lit(0).cast("bigint").alias("net"))
            else:
                held = spark.read.schema(DEPTHS).parquet(before)
                newest = held.agg(F.max("tick")).first()[0]
                kept = held.where(F.col("tick") == newest).select("tick", "route", F.col("depth").alias("net"))
                low = newest + 1
            # A row per listed queue and tick of the batch: ticks are few, as each is minutes long.
            ticks = listed.select(F.explode(F.sequence(F.lit(low).cast("bigint"), F.lit(high).cast("bigint"))).alias("tick"), "route")
            moves = ticks.join(batch, ["tick", "route"], "left").select("tick", "route", F.coalesce("net", F.lit(0)).alias("net"))
            running = Window.partitionBy("route").orderBy("tick").rowsBetween(Window.unboundedPreceding, Window.currentRow)
            depth = kept.unionByName(moves).withColumn("depth", F.sum("net").over(running)).where(
                F.col("tick") >= low).select("tick", "route", "depth")
            depth.write.mode("overwrite").parquet(f"{path}/depth/batch_id={batch_id}")
            written = spark.read.schema(DEPTHS).parquet(f"{path}/depth/batch_id={batch_id}")
            backlog_alerts(written, limit, "tick").write.mode("overwrite").parquet(f"{path}/alerts/batch_id={batch_id}")
        finally:
            batch.unpersist()

    return write


def check_depth(
    moves: DataFrame, path: str, checkpoint: str, queues: Sequence[str] = tuple(rules.QUEUES),
    limit: int = rules.BACKLOG_LIMIT, every: str | None = POLL_EVERY, **ticks,
) -> StreamingQuery:
    """Check the depth of all queues for every tick of the stream of moves, as long as it runs."""
    return start(net_moves(moves, **ticks), depth_batches(path, queues, limit), checkpoint, every)


def alerts(spark: SparkSession, path: str) -> DataFrame:
    """All alerts so far: tick, route, depth, message."""
    return spark.read.schema("tick bigint, route string, depth bigint, message string").parquet(f"{path}/alerts").drop("batch_id")
