"""Facts of a stream exactly once, whichever of several places a batch ends up in.

A batch is written to a staged folder of its own, named anew on each try. Then one small commit file names that folder;
it is put in place by a rename, which only one try can win. Readers look at the commits alone: what a failed
try has left behind is never read, a batch that is repeated after its commit is not written again, and
a batch that moved from one place to another between tries is in one of them.
"""

from __future__ import annotations

import json
import logging
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

from roadpulse.sinks.writers import BatchWriter

log = logging.getLogger(__name__)
Save = Callable[[DataFrame, str], None]


def save_parquet(batch: DataFrame, folder: str) -> None:
    batch.write.parquet(folder)


def committed_batches(commits: str, places: Sequence[tuple[str, Save]]) -> BatchWriter:
    """A batch writer that saves to the first of ``places`` (root, save) that takes the batch, then commits it at ``commits``.

    Raises, uncommitted, if none does; the batch is then tried again.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if _is_committed(spark, commits, batch_id):
            return
        batch.persist()
        try:
            for last, (root, save) in enumerate(places, start=1):
                folder = f"{root}/batch_id={batch_id}-{uuid.uuid4().hex}"
                try:
                    save(batch, folder)
                    break
                except Exception:
                    if last == len(places):
                        raise
                    log.exception("batch %s: place %s failed, using the next", batch_id, root)
            _commit(spark, commits, batch_id, folder)
        finally:
            batch.unpersist()

    return write


def read_committed(spark: SparkSession, commits: str, schema: str, under: str | None = None) -> DataFrame:
    """All committed rows, or those in folders below ``under``, for tables of parquet files."""
    folders = [f for f in committed_folders(spark, commits) if under is None or f.startswith(f"{under}/")]
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*folders)


def committed_folders(spark: SparkSession, commits: str) -> list[str]:
    """The folder of each committed batch, in order of batches: one short text a batch."""
    place = _path(spark, commits)
    if not _files(spark, place).exists(place):
        return []
    found = [json.loads(r.value) for r in spark.read.text(f"{commits}/batch-*.json").collect()]
    return [f["folder"] for f in sorted(found, key=lambda f: f["batch_id"])]


def _commit(spark: SparkSession, commits: str, batch_id: int, folder: str) -> None:
    own, final = _path(spark, f"{commits}/.{uuid.uuid4().hex}"), _path(spark, f"{commits}/batch-{batch_id}.json")
    files = _files(spark, own)
    out = files.create(own)
    out.write(bytearray(json.dumps({"batch_id": batch_id, "folder": folder}).encode()))
    out.close()
    if files.exists(final) or not files.rename(own, final):
        files.delete(own, False)  # another try of this batch was first


def _is_committed(spark: SparkSession, commits: str, batch_id: int) -> bool:
    place = _path(spark, f"{commits}/batch-{batch_id}.json")
    return _files(spark, place).exists(place)


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _files(spark: SparkSession, place):
    return place.getFileSystem(spark._jsc.hadoopConfiguration())
