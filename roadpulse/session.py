"""Session helpers for tests, the bench and the shared scratch folder."""

from __future__ import annotations

import atexit
import functools
import re
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(cpus: int | str = 8, app: str = "roadpulse") -> SparkSession:
    """A local session, as the tests and the bench use it."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh path under the shared folder of the cluster.

    The folder is the session's ``spark.checkpoint.dir``. Only a local session
    that leaves it unset gets a folder of its own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        base = _own_folder()
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def discard(spark: SparkSession, path: str) -> None:
    """Remove a table below the shared folder that nothing reads any more."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def has_files(spark: SparkSession, path: str) -> bool:
    """Whether there is a table or folder at ``path``."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def newest_part(spark: SparkSession, path: str, key: str, below: int | None = None) -> str | None:
    """The folder ``path/key=N`` of the largest N (smaller than ``below``) that was written to its end; None if there is none."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(place):
        return None
    numbers = [int(m[1]) for s in files.listStatus(place) if (m := re.fullmatch(rf"{key}=(\d+)", s.getPath().getName()))]
    for n in sorted(numbers, reverse=True):
        done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{key}={n}/_SUCCESS")
        if (below is None or n < below) and files.exists(done):
            return f"{path}/{key}={n}"
    return None


@functools.cache
def _own_folder() -> str:
    """One folder per process, gone when it ends."""
    made = tempfile.mkdtemp(prefix="roadpulse-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    return made
