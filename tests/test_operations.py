"""Queues, trails, histograms, counters and sinks."""

from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from roadpulse import rules
from roadpulse.operators import anomalies, operations
from roadpulse.session import shared_dir
from roadpulse.sinks import writers
from roadpulse.streaming import run
from roadpulse.streaming.speed import with_event_time


def test_queue_depth_and_backlog(spark):
    rows = spark.range(1999).select(
        F.when(F.col("id") < 1000, rules.MEDIA_QUEUE).otherwise(rules.INTERNAL_QUEUE).alias("route"))
    depth = operations.queue_depth(rows)
    got = {r.route: r.depth for r in depth.collect()}
    assert got == dict.fromkeys(rules.QUEUES, 0) | {rules.MEDIA_QUEUE: 1000, rules.INTERNAL_QUEUE: 999}
    alerts = operations.backlog_alerts(depth).collect()
    assert [a.message for a in alerts] == [
        "Alert: Queue media_car_triggers length 1000 exceeds or equals threshold 1000"]


@pytest.mark.parametrize("chunk", [1, 2, 1000])
def test_trail(spark, chunk):
    steps = spark.createDataFrame(
        [(1, 12, "c"), (1, 3, "a"), (1, 10, "b"), (2, 5, "x"), (2, 6, "DB Write Success")],
        "log_id bigint, step bigint, name string")
    got = {r.log_id: (r.process_log, r.process_status, r.n_steps)
           for r in operations.completed_trail(operations.process_trail(steps, chunk)).collect()}
    assert got == {1: ("a -> b -> c", "c", 3), 2: ("x -> DB Write Success", "Completed", 2)}


def test_queue_head(spark):
    rows = spark.range(100, numPartitions=4).selectExpr("if(id % 10 = 0, 'a', 'b') as route", "99 - id as seq")
    got = {(r.route, r.place): r.seq for r in operations.queue_head(rows, 2).collect()}
    assert got == {("a", 1): 9, ("a", 2): 19, ("b", 1): 0, ("b", 2): 1}
    plan = operations.queue_head(rows, 2)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan


def test_steps_of_a_route(spark):
    rows = spark.sql("select 3 as log_id, 'media_car_triggers' as route")
    assert [tuple(r) for r in operations.as_steps(rows, 2).collect()] == [(3, 2, "media_car_triggers")]


def test_orphans(spark):
    steps = spark.createDataFrame([(1, True), (1, False), (2, False), (2, False), (3, True)],
                                  "log_id bigint, is_insert boolean")
    assert [(r.log_id, r.n_updates) for r in operations.process_log_orphans(steps).collect()] == [(2, 2)]


def test_histogram_bounds_are_inclusive(spark):
    rows = spark.createDataFrame([("q", "t", d) for d in (5, 6, 10_000, 10_001)],
                                 "queue_type string, vehicle_type string, d bigint")
    got = {r.le: (r["count"], r.sum_seconds, r.total) for r in operations.duration_histogram(rows, "d").collect()}
    assert got["0.005"] == (1, 20.012, 4)
    assert got["0.01"][0] == 2 and got["5.0"][0] == 2 and got["10.0"][0] == 3 and got["+Inf"][0] == 4
    assert len(got) == len(rules.DURATION_BOUNDS) + 1


def test_latest_size(spark):
    rows = spark.createDataFrame([("q", "t", 5, 1, 10), ("q", "t", 5, 2, 20), ("q", "t", 4, 9, 30)],
                                 "queue_type string, vehicle_type string, ts bigint, seq bigint, size bigint")
    assert [r.size for r in operations.queue_size_latest(rows).collect()] == [20]


@pytest.fixture
def found(spark):
    rows = spark.sql("""select 'v' as vin, 1L as kafka_ts, 86400000L * id as sig_ts, id as seq,
        'AEB' as sig_name, cast(true as variant) as value from range(3)""")
    return anomalies.system_signals(rows)


def broken(batch, batch_id):
    raise OSError("down")


def test_two_tiers(spark, found, tmp_path):
    json_path, table_path = str(tmp_path / "json"), str(tmp_path / "table")
    writers.two_tier(writers.json_batches(json_path), broken)(found, 0)
    assert spark.read.text(json_path).count() == 3
    second = writers.two_tier(broken, writers.table_batches(table_path))
    second(found, 4)
    second(found, 4)  # the same batch again must not double
    table = spark.read.parquet(table_path)
    assert table.count() == 3
    assert table.select("event_date").distinct().count() == 3
    assert {r.current_value for r in table.collect()} == {"true"}
    with pytest.raises(OSError):
        writers.two_tier(broken, broken)(found, 5)


def test_failed_batch_is_tried_again(spark, tmp_path):
    """Both sinks down: the stream stops without committing; after a restart every row arrives."""
    src, out, checkpoint = (str(tmp_path / n) for n in ("src", "out", "cp"))
    spark.sql("select 'v' as vin, id as seq from range(5)").write.parquet(src)
    stream = spark.readStream.schema("vin string, seq bigint").parquet(src).selectExpr(
        "vin", "seq", "1L as kafka_ts", "2L as sig_ts", "'AEB' as sig_name", "cast(1 as variant) as value")
    fired = anomalies.system_signals(stream)
    with pytest.raises(Exception):
        run.start(fired, writers.two_tier(broken, broken), checkpoint, every=None).awaitTermination()
    good = writers.two_tier(broken, writers.table_batches(out))
    run.start(fired, good, checkpoint, every=None).awaitTermination()
    assert spark.read.parquet(out).count() == 5


def test_repeats_are_dropped(spark, tmp_path):
    src = str(tmp_path / "src")
    spark.sql("select 'v' as vin, id % 3 as seq, 1000L * id as sig_ts from range(6)").write.parquet(src)
    stream = with_event_time(spark.readStream.schema("vin string, seq bigint, sig_ts bigint").parquet(src))
    assert run.drain(run.without_repeats(stream).select("seq"), "t-once").count() == 3


def test_catalog_table_grows(spark, found):
    base = shared_dir(spark, "t-table")
    spark.sql("create database if not exists t_roadpulse location '%s'" % base)
    spark.sql("drop table if exists t_roadpulse.anomaly_data")
    writers.append_anomalies(found, "t_roadpulse.anomaly_data")
    writers.append_anomalies(found, "t_roadpulse.anomaly_data")
    table = spark.table("t_roadpulse.anomaly_data")
    assert table.count() == 6
    assert "event_date" in table.columns
    spark.sql("drop database t_roadpulse cascade")


def test_rows_with_time_of_writing(spark, tmp_path):
    writers.append_rows(spark.range(2), str(tmp_path / "facts"))
    writers.append_rows(spark.range(2), str(tmp_path / "facts"))
    back = spark.read.parquet(str(tmp_path / "facts"))
    assert back.count() == 4 and back.where("created_at is null").count() == 0
    writers.row_batches(str(tmp_path / "b"))(spark.range(2), 1)
    writers.row_batches(str(tmp_path / "b"))(spark.range(2), 1)
    assert spark.read.parquet(str(tmp_path / "b")).count() == 2


def session_with(master, folder):
    conf = SimpleNamespace(get=lambda key, default: folder if key == "spark.checkpoint.dir" else default)
    return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master))


def test_shared_dir_comes_from_the_session():
    assert shared_dir(session_with("yarn", "/shared/x/"), "p").startswith("/shared/x/p-")
    assert shared_dir(session_with("local[2]", None), "p") != shared_dir(session_with("local[2]", None), "p")
    with pytest.raises(ValueError):
        shared_dir(session_with("yarn", None), "p")
