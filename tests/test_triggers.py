"""Trigger feed, usage lookup, routing."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from roadpulse import rules
from roadpulse.operators import triggers
from roadpulse.sinks import writers
from roadpulse.sources import trigger_feed


def page(*records):
    return json.dumps({"code": "0", "total": len(records), "page": 1, "page_size": 10, "data": [
        {"vin": vin, "timestamp": ts, "car_type": "T", "tag": [],
         "trigger_info": [{"trigger_id": i, "trigger_name": "n"} for i in ids]}
        for vin, ts, ids in records
    ]})


@pytest.fixture
def pages(spark, tmp_path):
    (tmp_path / "p1.json").write_text(page(("A", "100", [9, 62, 1]), ("A", "12a", [1]), ("B", " 12", [1])))
    (tmp_path / "p2.json").write_text(page(
        ("B", "1.5", [1]), ("B", "9223372036854775808", [1]), ("B", "+200", [123]), ("C", "-5", []), ("C", "7", [9])))
    return trigger_feed.read_pages(spark, str(tmp_path))


def usage_table(spark, rows):
    return spark.createDataFrame(rows, "id bigint, vin string, create_ms bigint, use_type string")


def test_ingest(spark, pages):
    usage = usage_table(spark, [(3, "A", 50, "media"), (7, "A", 90, "internal"), (1, "A", 101, "production")])
    rows = triggers.ingest(pages, usage).collect()
    assert sorted((r.vin, r.timestamp, r.usage_type, r.trigger_id) for r in rows) == [
        ("A", 100, "media", "62"), ("B", 200, "none", "123")]
    reasons = sorted((r.vin, r.raw_timestamp, r.reason) for r in triggers.dropped_records(pages).collect())
    assert [r[2] for r in reasons] == ["bad_timestamp"] * 4 + ["no_allowed_trigger"] * 2


def test_lookup_picks(spark):
    usage = usage_table(spark, [
        (3, "A", 10, "first"), (7, "A", 20, "second"), (1, "A", 500, "later"), (9, None, 0, "nobody")])
    asked = spark.createDataFrame([("A", 9), ("A", 10), ("A", 25), ("A", 500), ("Z", 25), (None, 25)],
                                  "vin string, timestamp bigint")
    for bucket in (7, 1000):
        get = lambda pick: {
            (r.vin, r.timestamp): r.usage_type
            for r in triggers.usage_lookup(asked, usage, pick, bucket_ms=bucket).collect()}
        assert get("first") == {("A", 9): "none", ("A", 10): "first", ("A", 25): "first",
                                ("A", 500): "later", ("Z", 25): "none", (None, 25): "none"}
        assert get("latest") == {("A", 9): "none", ("A", 10): "first", ("A", 25): "second",
                                 ("A", 500): "later", ("Z", 25): "none", (None, 25): "none"}


@pytest.mark.parametrize("pick", ["first", "latest"])
def test_lookup_against_all_pairs(spark, pick):
    """One vehicle holds most rows; several assignments share a time; equal triggers are all kept."""
    rng = np.random.default_rng(6)
    vin = lambda n: [f"v{max(0, int(x) - 6)}" for x in rng.integers(0, 10, n)]
    dims = [(int(i), v, int(t), f"u{i}") for i, v, t in zip(rng.permutation(80), vin(80), rng.integers(0, 100, 80))]
    asked = [(v, int(t)) for v, t in zip(vin(400), rng.integers(-10, 120, 400))]

    def best(v, t):
        known = [d for d in dims if d[1] == v and d[2] <= t]
        if not known:
            return "none"
        return (min(known) if pick == "first" else max(known, key=lambda d: (d[2], d[0])))[3]

    got = triggers.usage_lookup(
        spark.createDataFrame(asked, "vin string, timestamp bigint"), usage_table(spark, dims), pick, bucket_ms=13
    ).collect()
    assert sorted((r.vin, r.timestamp, r.usage_type) for r in got) == sorted((v, t, best(v, t)) for v, t in asked)


def test_pick_must_be_known(spark):
    with pytest.raises(ValueError):
        triggers.usage_lookup(spark.range(1), spark.range(1), "nearest")


def test_routes(spark):
    uses = ["test_drive", "media", "internal", "production", "perception", None]
    rows = spark.createDataFrame([(i, u) for i, u in enumerate(uses)], "i int, usage_type string")
    got = [r.route for r in triggers.route_by_usage(rows).orderBy("i").collect()]
    assert got == [rules.TEST_DRIVE_QUEUE, rules.MEDIA_QUEUE, rules.INTERNAL_QUEUE] + [rules.PRODUCTION_QUEUE] * 3


def test_duplicate_allowed_id_does_not_double(spark, pages):
    kept = triggers.label_records(pages).where("reason is null")
    assert kept.where("trigger_id = '123'").count() == 1


def test_can_file(spark):
    rows = spark.sql("""select 1 as i, named_struct('vin', 'A', 'timestamp', '5', 'file_info', array(
        named_struct('file_type', 'video', 'file_url', 'x'), named_struct('file_type', 'can', 'file_url', 'a'),
        named_struct('file_type', 'can', 'file_url', 'b'))) as data
      union all select 2, named_struct('vin', 'B', 'timestamp', '6', 'file_info', array())""")
    got = {r.i: (r.file_url, r.error) for r in trigger_feed.select_can_file(rows, "i").collect()}
    assert got == {1: ("a", None), 2: (None, "no_can_file")}


def test_routes_round_trip(spark, tmp_path):
    usage = usage_table(spark, [(1, "A", 0, "media")])
    rows = spark.createDataFrame([("A", 5), ("B", 6)], "vin string, timestamp bigint")
    routed = triggers.route_by_usage(triggers.usage_lookup(rows, usage)).withColumns({
        "car_type": F.lit(None).cast("string"), "trigger_id": F.lit("1"), "log_id": F.lit(0),
        "threshold_log": F.lit(""), "is_crash": F.lit(0)})
    text = writers.encode_triggers(routed).where("vin = 'A'").first().value
    assert text == ('{"vin":"A","timestamp":5,"car_type":null,"usage_type":"media","trigger_id":"1",'
                    '"log_id":0,"threshold_log":"","is_crash":0}')
    writers.write_routes(routed, str(tmp_path / "q"))
    back = writers.read_route(spark, str(tmp_path / "q"), rules.MEDIA_QUEUE).collect()
    assert [(r.vin, r.timestamp, r.usage_type) for r in back] == [("A", 5, "media")]


def test_pages_as_a_stream(spark, tmp_path):
    from roadpulse.streaming import run

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "p1.json").write_text(page(("A", "100", [9, 62, 1]), ("A", "12a", [1])))
    kept = triggers.label_records(trigger_feed.stream_pages(spark, str(tmp_path / "in"))).where("reason is null")
    assert [r.trigger_id for r in run.drain(kept, "t-pages").collect()] == ["62"]


def test_timed_ingest_puts_pages_on_routes(spark, tmp_path):
    from roadpulse.streaming import run

    assert run.POLL_EVERY == "5 minutes"
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "p1.json").write_text(page(("A", "100", [9, 62, 1]), ("A", "12a", [1]), ("B", "7", [3])))
    usage = usage_table(spark, [(3, "A", 50, "media")])
    for _ in range(2):  # the second run finds no new page
        pages = trigger_feed.stream_pages(spark, str(tmp_path / "in"))
        query = run.ingest_pages(pages, usage, str(tmp_path / "q"), str(tmp_path / "check"), every=None)
        query.awaitTermination()
    waiting = {r: writers.read_route(spark, str(tmp_path / "q"), r).collect() for r in (rules.MEDIA_QUEUE, rules.PRODUCTION_QUEUE)}
    assert [(r.vin, r.timestamp) for r in waiting[rules.MEDIA_QUEUE]] == [("A", 100)]
    assert [(r.vin, r.timestamp) for r in waiting[rules.PRODUCTION_QUEUE]] == [("B", 7)]
    ids = [r.log_id for rows in waiting.values() for r in rows]
    assert len(set(ids)) == 2 and all(i > 0 for i in ids)
