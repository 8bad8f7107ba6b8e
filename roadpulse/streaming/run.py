"""Start streams, and run one to its end."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from roadpulse.operators.triggers import ingest, route_by_usage
from roadpulse.session import shared_dir
from roadpulse.sinks.writers import write_routes

# Checkpoint interval of the signal stream, polling interval of the trigger feed.
CHECKPOINT_EVERY = "60 seconds"
POLL_EVERY = "5 minutes"


# Fixed value: the class of the state store that keeps state on disk, so that it may outgrow memory.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """Streams started from now on keep their state in RocksDB and checkpoint changes only.

    An order to the session, so it holds for all its later streams; a stream keeps the store it was first started with.
    """
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")


def start(
    df: DataFrame,
    write_batch: Callable[[DataFrame, int], None],
    checkpoint: str,
    every: str | None = CHECKPOINT_EVERY,
) -> StreamingQuery:
    """Feed each micro-batch to ``write_batch``; ``every=None`` takes what is there and stops."""
    use_rocksdb(df.sparkSession)
    writer = df.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    return writer.start()


def drain(df: DataFrame, purpose: str) -> DataFrame:
    """Run the stream over all data now available and return what it wrote, as a table."""
    spark = df.sparkSession
    use_rocksdb(spark)
    base = shared_dir(spark, purpose)
    query = (
        df.writeStream.format("parquet").outputMode("append")
        .option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{base}/out")


def without_repeats(df: DataFrame, keys: Sequence[str] = ("vin", "seq")) -> DataFrame:
    """Drop rows a source sends twice within the watermark delay; needs a watermark on ``df``."""
    return df.dropDuplicatesWithinWatermark(list(keys))


def ingest_pages(
    pages: DataFrame, usage: DataFrame, path: str, checkpoint: str, every: str | None = POLL_EVERY
) -> StreamingQuery:
    """Ingest the trigger pages that have landed, every five minutes, and put them on their routes below ``path``.

    A batch has a folder of its own, which it overwrites when it is repeated.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        write_routes(route_by_usage(ingest(batch, usage)), f"{path}/batch_id={batch_id}", "overwrite")

    return start(pages, write, checkpoint, every)


def show(df: DataFrame, every: str = CHECKPOINT_EVERY) -> StreamingQuery:
    """Print a stream to the console, for debugging."""
    return df.writeStream.format("console").trigger(processingTime=every).start()
