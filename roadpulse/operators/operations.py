"""The pipeline about itself: queues, process trails, counters and histograms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadpulse import rules
from roadpulse.functions.literals import literal_table


# Fixed value: the name of the step that ends a log.
WRITTEN = "DB Write Success"


def queue_depth(rows: DataFrame, queues: Sequence[str] = tuple(rules.QUEUES)) -> DataFrame:
    """Rows per queue, every listed queue included."""
    listed = literal_table(rows.sparkSession, [(q,) for q in queues], "route string")
    counted = rows.groupBy("route").agg(F.count(F.lit(1)).alias("depth"))
    # At most one counted row per listed queue survives the join, so it stays tiny.
    return listed.join(counted, "route", "left").select(
        "route", F.coalesce("depth", F.lit(0)).cast("bigint").alias("depth")
    )


def backlog_alerts(depth: DataFrame, limit: int = rules.BACKLOG_LIMIT, *keep: str) -> DataFrame:
    """A message for each queue as long as the limit or longer, after the columns to ``keep``."""
    return depth.where(F.col("depth") >= limit).select(
        *keep, "route", "depth", F.format_string(rules.BACKLOG_TEXT, "route", "depth", F.lit(limit)).alias("message")
    )


def queue_head(rows: DataFrame, n: int, order: str = "seq") -> DataFrame:
    """The ``n`` rows each queue would hand out next, oldest first, with their ``place``.

    Each task keeps its own first ``n`` rows per queue before the shuffle, so a
    queue that holds most of the rows costs no more than the others.
    """
    place = F.row_number().over(Window.partitionBy("route").orderBy(order))
    return rows.withColumn("place", place).where(F.col("place") <= n)


def as_steps(rows: DataFrame, step: int) -> DataFrame:
    """Step events for triggers that have just been put on their ``route``."""
    return rows.select("log_id", F.lit(step).cast("bigint").alias("step"), F.col("route").alias("name"))


def step_events(
    ingested: DataFrame, routed: DataFrame, judged: DataFrame, written: DataFrame, done: str = WRITTEN
) -> DataFrame:
    """The steps of all triggers so far: put on the default route, on their usage's, on their verdict's, written.

    Each frame has log_id, those on a route also ``route``. A trigger that is
    read or judged twice leaves one event per step.
    """
    events = as_steps(ingested.withColumn("route", F.lit(rules.DEFAULT_QUEUE)), 1).withColumn("is_insert", F.lit(True))
    for step, rows in ((2, routed), (3, judged), (4, written.withColumn("route", F.lit(done)))):
        events = events.unionByName(as_steps(rows, step).withColumn("is_insert", F.lit(False)))
    return events.distinct()


def trail_steps(judged: DataFrame, usage_route: Column, done: str = WRITTEN) -> DataFrame:
    """As ``step_events``, from one frame of triggers: put on the default route, on ``usage_route``, on the ``route`` of
    their verdict if they have one, and written if that is the write queue. The frame is worked out once."""
    def step(number: int, name: Column) -> Column:
        return F.struct(F.lit(number).cast("bigint").alias("step"), name.alias("name"), F.lit(number == 1).alias("is_insert"))

    written = F.when(F.col("route") == rules.WRITE_DB_QUEUE, F.lit(done))
    each = F.array(step(1, F.lit(rules.DEFAULT_QUEUE)), step(2, usage_route), step(3, F.col("route")), step(4, written))
    return judged.select("log_id", F.explode(each).alias("s")).where("s.name is not null").select("log_id", "s.*").distinct()


def process_trail(steps: DataFrame, chunk: int = 1_000) -> DataFrame:
    """Per log its steps as ``a -> b -> c`` and the name of the last step as status.

    The text is put together in two rounds, first for ``chunk`` consecutive step
    numbers, then over the chunks, so that a log with very many steps is
    assembled in many tasks and only finished texts meet in one.
    """

    def joined(order: str, text: str) -> Column:
        sorted_steps = F.array_sort(F.collect_list(F.struct(order, text)))
        return F.array_join(F.transform(sorted_steps, lambda s: s[text]), " -> ")

    status = F.max_by("name", "step")
    parts = (
        steps.withColumn("_chunk", F.floor(F.col("step") / chunk))
        .groupBy("log_id", "_chunk")
        .agg(
            joined("step", "name").alias("text"),
            status.alias("name"),
            F.max("step").alias("step"),
            F.count(F.lit(1)).alias("n"),
        )
    )
    return parts.groupBy("log_id").agg(
        joined("_chunk", "text").alias("process_log"),
        status.alias("process_status"),
        F.sum("n").alias("n_steps"),
    )


def completed_trail(trails: DataFrame, done: str = WRITTEN) -> DataFrame:
    """Trails whose last step is the database write get the status Completed."""
    return trails.withColumn(
        "process_status",
        F.when(F.col("process_status") == done, "Completed").otherwise(F.col("process_status")),
    )


def process_log_orphans(steps: DataFrame) -> DataFrame:
    """Logs with updates but no insert (``is_insert`` never true), and how many updates.

    Insert and update rows of a log meet in one aggregate, so no join is needed.
    """
    return (
        steps.groupBy("log_id")
        .agg(F.max("is_insert").alias("known"), F.count_if(~F.col("is_insert")).alias("n_updates"))
        .where("not known")
        .select("log_id", "n_updates")
    )


def counter(rows: DataFrame, *labels: str) -> DataFrame:
    """Rows per label set."""
    return rows.groupBy(*labels).agg(F.count(F.lit(1)).alias("total"))


def messages_processed(rows: DataFrame, *more: str) -> DataFrame:
    return counter(rows, *more, "queue_type", "vehicle_type", "status")


def message_errors(rows: DataFrame, *more: str) -> DataFrame:
    return counter(rows, *more, "queue_type", "vehicle_type", "error_type")


def drop_reasons(rows: DataFrame) -> DataFrame:
    """Dropped records per reason."""
    return counter(rows, "reason")


def duration_histogram(
    rows: DataFrame,
    duration_ms: str,
    labels: Sequence[str] = ("queue_type", "vehicle_type"),
    bounds: Sequence[float] = tuple(rules.DURATION_BOUNDS),
) -> DataFrame:
    """Cumulative histogram: per label set and upper bound (seconds) the rows at most that long.

    Each row is read once: all bounds are counted side by side, and only the
    finished counts, one row per label set, are turned into one row per bound.
    The last bound is +Inf. Durations are whole ms, so sums are exact.
    """
    d = F.col(duration_ms)
    counts = [F.count_if(d <= F.lit(round(b * 1000))) for b in bounds]
    buckets = F.array(
        *[F.struct(F.lit(str(b)).alias("le"), c.alias("count")) for b, c in zip(bounds, counts)],
        F.struct(F.lit("+Inf").alias("le"), F.count(d).alias("count")),
    )
    return (
        rows.groupBy(*labels)
        .agg(buckets.alias("b"), F.sum(d).alias("sum_ms"), F.count(d).alias("total"))
        .select(*labels, F.explode("b").alias("b"), "sum_ms", "total")
        .select(*labels, "b.le", "b.count", (F.col("sum_ms") / 1000).alias("sum_seconds"), "total")
    )


def queue_size_latest(rows: DataFrame, *more: str) -> DataFrame:
    """Last reported size per label set."""
    return rows.groupBy(*more, "queue_type", "vehicle_type").agg(
        F.max_by("size", F.struct("ts", "seq")).alias("size")
    )


def in_windows(rows: DataFrame, width: str = "5 minutes", delay: str = "1 minute", ts: str = "ts") -> DataFrame:
    """Add ``window``, a label like any other, by the epoch ms in ``ts``.

    On a stream the metrics of a window come once, when the watermark, ``delay`` behind the newest row, has
    passed its end; rows later than that are left out. State holds one row per label set of the open windows.
    """
    timed = rows.withColumn("_at", F.timestamp_millis(ts)).withWatermark("_at", delay)
    return timed.withColumn("window", F.window("_at", width))


def window_start(metrics: DataFrame) -> DataFrame:
    """``window`` as the epoch ms of its start."""
    return metrics.withColumn("window", F.unix_millis("window.start")).withColumnRenamed("window", "window_start")
