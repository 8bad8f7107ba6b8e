"""Streams: the self join, state by slot with timers, late rows, metrics, the depth check and live rules."""

import glob

import pytest
from pyspark.sql import functions as F
from test_speed import feed, found, one_by_one, stream_of

from roadpulse import rules
from roadpulse.operators import operations
from roadpulse.plans import fixtures as fx
from roadpulse.streaming import depth, live_rules, run, speed, speed_join

CLOSING = ("closing", 10**6, 10**7, 0.0)  # a vehicle of its own, far ahead in time


def batches_of(spark, tmp_path, parts):
    """A stream of one micro-batch per part, each a list of (vin, seq, ts, speed)."""
    src = str(tmp_path / "in")
    for part in parts:
        spark.createDataFrame(part, "vin string, seq bigint, sig_ts bigint, speed double").coalesce(1).write.mode(
            "append").parquet(src)
    stream = spark.readStream.schema("vin string, seq bigint, sig_ts bigint, speed double").option(
        "maxFilesPerTrigger", 1).parquet(src)
    return stream.select("vin", F.col("sig_ts").alias("kafka_ts"), "sig_ts", "seq", F.lit("speed").alias("sig_name"),
                         F.col("speed").cast("variant").alias("value"))


@pytest.mark.parametrize(("slot_ms", "seed"), [(250, 11), (700, 12)])
def test_join_agrees_with_the_rule(spark, tmp_path, slot_ms, seed):
    """One vehicle holds most rows; rows come up to 19 s late over three batches."""
    rows = [(vin, 2 * seq, ts, v) for vin, seq, ts, v in feed(seed, n=500, vins=1, late=19_000)]
    # A quiet vehicle between them, each row where the feed is some 10 s further.
    rows += [("quiet", (i * 900 + 9_500) // 80 // 2 * 2 + 1, i * 900, float(i % 3 * 20)) for i in range(60)]
    rows = sorted(rows, key=lambda r: r[1])
    stream = batches_of(spark, tmp_path, [rows[:180], rows[180:400], rows[400:], [CLOSING]])
    got = found(run.drain(speed_join.joined(stream, slot_ms=slot_ms, bucket_ms=slot_ms * 20), "t-join"))
    want = one_by_one(rows)
    assert got == want and len(want) > 100


def test_join_wants_whole_slots(spark):
    with pytest.raises(ValueError):
        speed_join.joined(None, slot_ms=300)


def state_rows(spark, judged, tmp_path, purpose):
    """Rows in the state store after each micro-batch."""
    query = judged.writeStream.format("parquet").outputMode("append").option("path", str(tmp_path / purpose)).option(
        "checkpointLocation", str(tmp_path / f"{purpose}-c")).trigger(availableNow=True).start()
    query.awaitTermination()
    return [sum(s.numRowsTotal for s in p.stateOperators) for p in query.recentProgress]


def test_silent_vehicles_leave_without_new_rows(spark, tmp_path):
    run.use_rocksdb(spark)
    first = [(f"v{i}", i, 1000 + i, float(i)) for i in range(20)]
    parts = [first, [("other", 100, 200_000, 1.0)], [("other", 101, 400_000, 1.0)], [("other", 102, 600_000, 1.0)]]
    sizes = state_rows(spark, speed.judge_by_slot(batches_of(spark, tmp_path, parts)), tmp_path, "out")
    assert sizes[0] > 5 and sizes[-1] <= 2


def test_an_outage_loses_no_hit(spark, tmp_path):
    """Hours between the batches in processing or in the feed: what counts is the time since a slot's last rows."""
    hours = 10 * 3_600_000
    parts = [
        [("a", 0, 0, 0.0), ("b", 1, 500, 0.0)],
        [("a", 2, 900, 50.0), ("b", 3, hours, 0.0)],
        # Vehicle c was off line and sends what it kept, ten hours late, over two batches.
        [("c", 4, 1000, 0.0), ("b", 5, hours + 100, 60.0)],
        [("c", 6, 1800, 50.0), ("b", 7, hours + 200, 60.0)],
    ]
    run.use_rocksdb(spark)
    got = found(run.drain(speed.exact_by_slot(batches_of(spark, tmp_path, parts)), "t-outage"))
    assert got == one_by_one([r for part in parts for r in part])
    assert [h[:2] for h in got] == [("a", 2), ("b", 5), ("b", 7), ("c", 6)]


def test_late_rows_and_hits_from_one_pass(spark, tmp_path):
    parts = [
        [("a", 0, 1000, 0.0), ("b", 1, 100_000, 0.0)],
        [("b", 2, 200_000, 0.0)],  # the watermark goes to 72 s here, and 172 s from the next batch on: a's slot leaves
        [("b", 3, 200_500, 50.0)],
        [("a", 4, 1500, 50.0), ("b", 5, 170_000, 1.0), ("b", 6, 201_000, 50.0)],
    ]
    written = {"hits": [], "late": []}
    take = lambda name: lambda df, _: written[name].extend(df.collect())
    judged = speed.judge_by_slot(batches_of(spark, tmp_path, parts))
    run.start(judged, speed.hits_and_late(take("hits"), take("late")), str(tmp_path / "c"), every=None).awaitTermination()
    assert sorted(r.seq for r in written["hits"]) == [3, 6]
    assert sorted((r.seq, r.late_ms, r.reason) for r in written["late"]) == [
        (4, 200_500 - 28_000 - 1500, "slot_gone"), (5, 172_500 - 170_000, "slot_gone")]


def test_metrics_leave_out_what_is_too_late(spark, tmp_path):
    src, schema = str(tmp_path / "in"), "queue_type string, vehicle_type string, status string, ts bigint"
    minute = 60_000
    for part in ([("q", "T", "ok", 0), ("q", "T", "ok", 4 * minute)], [("q", "T", "ok", 20 * minute)], [("q", "T", "ok", 22 * minute)],
                 [("q", "T", "ok", 1 * minute), ("q", "T", "ok", 21 * minute)], [("q", "T", "ok", 90 * minute)]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    counted = operations.window_start(operations.messages_processed(operations.in_windows(stream), "window"))
    got = [(r.window_start, r.total) for r in run.drain(counted, "t-metrics").collect()]
    assert sorted(got) == [(0, 2), (20 * minute, 3)]


def test_depth_is_kept_from_batch_to_batch(spark, tmp_path):
    """Ticks of five minutes; a repeated batch changes nothing, and a tick without moves has the depth before it."""
    path, write = str(tmp_path), None
    write = depth.depth_batches(path, ["a", "b"], limit=3)
    schema = "tick bigint, route string, net bigint"
    first = spark.createDataFrame([(10, "a", 2), (12, "a", 1), (12, "b", -1), (12, "unlisted", 9)], schema)
    second = spark.createDataFrame([(14, "a", -2), (14, "b", 5)], schema)
    for batch_id, batch in ((0, first), (1, second), (1, second), (2, second.limit(0)), (5, second.withColumn("tick", F.lit(15)))):
        write(batch, batch_id)
    rows = spark.read.parquet(f"{path}/depth").select("tick", "route", "depth").collect()
    assert sorted(map(tuple, rows)) == [
        (10, "a", 2), (10, "b", 0), (11, "a", 2), (11, "b", 0), (12, "a", 3), (12, "b", -1), (13, "a", 3), (13, "b", -1),
        (14, "a", 1), (14, "b", 4), (15, "a", -1), (15, "b", 9)]
    assert sorted((r.tick, r.route) for r in depth.alerts(spark, path).collect()) == [
        (12, "a"), (13, "a"), (14, "b"), (15, "b")]


def test_rules_are_read_anew(spark, tmp_path):
    path = str(tmp_path / "rules")
    with pytest.raises(ValueError):
        live_rules.thresholds(spark, path)
    live_rules.publish(spark, live_rules.threshold_rows(), live_rules.THRESHOLDS, path)
    assert live_rules.thresholds(spark, path) == {k: list(v) for k, v in rules.RULES_BY_ROUTE.items()}
    live_rules.publish(spark, [("r", 1, "b", "crash", 0.5, 3), ("r", 0, "a", "crash", 0.7, 3)], live_rules.THRESHOLDS, path)
    assert [r.name for r in live_rules.thresholds(spark, path)["r"]] == ["a", "b"]
    # A version that was not written to its end doesn't count.
    spark.createDataFrame([("x", 0, "x", "x", 1.0, 1)], live_rules.THRESHOLDS).write.parquet(f"{path}/version=2")
    for done in glob.glob(f"{path}/version=2/_SUCCESS"):
        fs = spark._jvm.org.apache.hadoop.fs.Path(done)
        fs.getFileSystem(spark._jsc.hadoopConfiguration()).delete(fs, False)
    assert list(live_rules.thresholds(spark, path)) == ["r"]
    system = str(tmp_path / "system")
    live_rules.publish(spark, [tuple(r) for r in rules.SYSTEM_RULES], live_rules.SYSTEM, system)
    assert sorted(live_rules.system_rules(spark, system)) == sorted(rules.SYSTEM_RULES)


def test_closing_batch_is_no_event(spark):
    stream = fx.event_batches(spark, "/root/testdata/sf0.001", closing=True)
    rows = run.drain(stream, "t-closing")
    assert rows.where("user_id = -1").count() == 1 and rows.where("user_id <> -1").count() == fx.events(
        spark, "/root/testdata/sf0.001").count()
