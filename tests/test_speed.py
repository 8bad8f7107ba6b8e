"""The speed rule: hand-made rows, and agreement of all its forms on shuffled feeds."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from roadpulse import rules
from roadpulse.functions.first_hit import first_hit
from roadpulse.operators import anomalies
from roadpulse.streaming import run, speed, speed_state

TIERS = [(t.tier, t.range_ms, t.limit) for t in rules.SPEED_TIERS]


def signal_frame(spark, rows):
    """rows: (vin, seq, ts, JSON text of the value)."""
    raw = spark.createDataFrame(rows, "vin string, seq bigint, sig_ts bigint, j string")
    return raw.select(
        "vin", F.col("sig_ts").alias("kafka_ts"), "sig_ts", "seq", F.lit("speed").alias("sig_name"),
        F.parse_json("j").alias("value"),
    )


def found(df):
    return sorted(
        (r.vin, r.seq, r.anomaly_type, r.previous_seq)
        for r in df.select("vin", "seq", "anomaly_type", "previous_seq").collect()
    )


def one_by_one(rows, retention=rules.SPEED_RETENTION_MS):
    """The rule as defined: rows (vin, seq, ts, speed) in arrival order, one state per vehicle."""
    kept, out = {}, []
    for vin, seq, ts, v in sorted(rows, key=lambda r: r[1]):
        past = kept.setdefault(vin, [])
        hits = [
            (t.anomaly_type, s)
            for t in rules.SPEED_TIERS
            for s, pts, pv in past
            if 0 <= ts - pts <= t.range_ms and abs(v - pv) > t.limit
        ]
        if hits:
            out.append((vin, seq, *hits[0]))
        past.append((seq, ts, v))
        while ts - past[0][1] > retention:
            past.pop(0)
    return sorted(out)


CASES = {
    "at the limit": ([(0, 0.0), (1000, 18.0)], []),
    "end of range counts": ([(0, 0.0), (1000, 18.5)], [(1, "SPEED_CHANGE_1S", 0)]),
    "over 1 s, under 24": ([(0, 0.0), (1001, 20.0)], []),
    "two seconds": ([(0, 0.0), (2000, 24.5)], [(1, "SPEED_CHANGE_2S", 0)]),
    "first arrival is named": (
        [(0, 0.0), (100, 60.0), (200, 30.0)],
        [(1, "SPEED_CHANGE_1S", 0), (2, "SPEED_CHANGE_1S", 0)],
    ),
    "same time": ([(0, 1.0), (0, 30.0)], [(1, "SPEED_CHANGE_1S", 0)]),
    "late row looks back only": (
        [(400, 0.0), (3400, 50.0), (1400, 50.0)], [(2, "SPEED_CHANGE_1S", 0)],
    ),
    "across a bucket end": ([(19_990, 0.0), (20_010, 50.0)], [(1, "SPEED_CHANGE_1S", 0)]),
    "before the epoch": ([(-1500, 0.0), (-600, 50.0)], [(1, "SPEED_CHANGE_1S", 0)]),
}


@pytest.mark.parametrize("part_rows", [1, 2, 300_000])
def test_hand_made_rows(spark, part_rows):
    rows, want = [], []
    for vin, (points, hits) in CASES.items():
        rows += [(vin, i, ts, str(v)) for i, (ts, v) in enumerate(points)]
        want += [(vin, *h) for h in hits]
    got = found(anomalies.speed_change(signal_frame(spark, rows), part_rows=part_rows))
    assert got == sorted(want)


def test_values_that_are_no_speed(spark):
    rows = [("v", i, i * 10, j) for i, j in enumerate(
        ["0.0", "null", "true", '"abc"', '"NaN"', '"25.5"', "1.0"])]
    got = found(anomalies.speed_change(signal_frame(spark, rows)))
    assert got == [("v", 5, "SPEED_CHANGE_1S", 0), ("v", 6, "SPEED_CHANGE_1S", 5)]


def feed(seed, n=1500, vins=3, span=60_000, late=20_000):
    rng = np.random.default_rng(seed)
    ts = np.sort(rng.integers(0, span, n))
    arrival = np.argsort(ts + rng.integers(0, late + 1, n), kind="stable")
    seq = np.empty(n, dtype=int)
    seq[arrival] = np.arange(n)
    speeds = np.round(rng.uniform(0, 45, n), 1)
    vin = [f"v{i}" for i in rng.integers(0, vins, n)]
    return [(v, int(s), int(t), float(x)) for v, s, t, x in zip(vin, seq, ts, speeds)]


def as_signals(spark, rows):
    return signal_frame(spark, [(v, s, t, str(x)) for v, s, t, x in rows])


@pytest.mark.parametrize("seed", [1, 2])
def test_all_forms_agree(spark, seed):
    rows = feed(seed)
    want = one_by_one(rows)
    assert len(want) > 100
    signals = as_signals(spark, rows)
    assert found(anomalies.speed_change(signals)) == want
    assert found(anomalies.speed_change(signals, bucket_ms=2_000)) == want
    assert found(anomalies.speed_change(signals, bucket_ms=30_000, part_rows=60)) == want


def test_one_vehicle_holds_most_rows(spark):
    """A crowded bucket is searched in parts, and nothing is lost."""
    rows = feed(5, n=6000, vins=1, span=20_000) + [
        (f"quiet{i}", 10_000 + i, i * 700, float(i % 2 * 40)) for i in range(50)
    ]
    rows += [("pair", 20_000, 0, 0.0), ("pair", 20_001, 10, 50.0)]
    assert found(anomalies.speed_change(as_signals(spark, rows), part_rows=500)) == one_by_one(rows)


def test_every_arrival_of_a_repeated_row_is_judged(spark):
    rows = [("v", 0, 0, 0.0), ("v", 0, 0, 0.0), ("v", 1, 100, 50.0), ("v", 1, 100, 50.0), ("v", 1, 100, 50.0)]
    want = [("v", 1, "SPEED_CHANGE_1S", 0)] * 3
    for part_rows in (1, 2, 300_000):
        assert found(anomalies.speed_change(as_signals(spark, rows), part_rows=part_rows)) == want


def test_one_shuffle_and_no_job_before_the_action(spark):
    rows = as_signals(spark, feed(1, n=50))
    jobs = lambda: len(spark.sparkContext.statusTracker().getJobIdsForGroup("plan"))
    spark.sparkContext.setJobGroup("plan", "plan")
    plan = anomalies.speed_change(rows)._jdf.queryExecution().executedPlan().toString()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs() == 0 and plan.count("Exchange") == 1 and plan.count("Scan") == 1


def stream_of(spark, tmp_path, rows, batches):
    src = tmp_path / "in"
    table = spark.createDataFrame(rows, "vin string, seq bigint, sig_ts bigint, speed double")
    step = -(-len(rows) // batches)
    for i in range(batches):
        part = table.where((F.col("seq") >= i * step) & (F.col("seq") < (i + 1) * step))
        part.coalesce(1).write.mode("append").parquet(str(src))
    stream = (
        spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1)
        .option("latestFirst", "false").parquet(str(src))
    )
    return stream.select(
        "vin", F.col("sig_ts").alias("kafka_ts"), "sig_ts", "seq",
        F.lit("speed").alias("sig_name"), F.col("speed").cast("variant").alias("value"),
    )


def test_stream_exact_over_several_batches(spark, tmp_path):
    rows = feed(7, n=600)
    got = found(run.drain(speed.exact(stream_of(spark, tmp_path, rows, 3)), "t-exact"))
    assert got == one_by_one(rows)


def test_stream_by_slot_over_several_batches(spark, tmp_path):
    """Same rows at once from state per slot, rows up to 28 s late included."""
    rows = feed(9, n=600, late=27_000)
    stream = stream_of(spark, tmp_path, rows, 3)
    got = found(run.drain(speed.exact_by_slot(stream, deals=4), "t-slot"))
    assert got == one_by_one(rows)


def test_a_late_row_still_hits(spark, tmp_path):
    """Five batches of a row each; the last is 21.5 s late and over the limit against the first."""
    rows = [("v", 0, 0, 0.0), ("v", 1, 10_000, 0.0), ("v", 2, 20_000, 0.0), ("v", 3, 22_000, 0.0), ("v", 4, 500, 50.0)]
    for name, form in (("exact", speed.exact), ("slot", speed.exact_by_slot)):
        got = found(run.drain(form(stream_of(spark, tmp_path / name, rows, 5)), "t-late"))
        assert got == [("v", 4, "SPEED_CHANGE_1S", 0)], name


def test_state_drops_only_from_the_old_end():
    """Very late rows meet whatever is still kept, as with a plain first-in-first-out list."""
    rng = np.random.default_rng(3)
    for _ in range(30):
        n = 80
        ts = rng.integers(0, 90_000, n)
        v = np.round(rng.uniform(0, 40, n), 1)
        rows = [("v", i, int(t), float(x)) for i, (t, x) in enumerate(zip(ts, v))]
        frame = pd.DataFrame(
            {"vin": "v", "kafka_ts": ts, "sig_ts": ts, "seq": range(n), "sig_name": "speed", "speed": v})
        kept, got = frame[["sig_ts", "seq", "speed"]].head(0), []
        for cut in np.array_split(np.arange(n), 4):
            hits, kept = speed_state.judge(kept, frame.iloc[cut], TIERS, 30_000)
            got += [("v", h.seq, rules.SPEED_TIERS[h.tier - 1].anomaly_type, h.previous_seq)
                    for h in hits.itertuples()]
        assert sorted(got) == one_by_one(rows)


@pytest.mark.parametrize("small", [0, 100_000])
def test_first_hit_against_all_pairs(monkeypatch, small):
    monkeypatch.setattr("roadpulse.functions.first_hit.SMALL", small)
    rng = np.random.default_rng(4)
    for _ in range(100):
        n = int(rng.integers(1, 60))
        ts = rng.integers(-4000, 4000, n)
        seq = rng.permutation(n)
        v = np.round(rng.uniform(0, 50, n), 1)
        at = first_hit(ts, seq, v, ts, seq, v, 1000, 18.0)
        for i in range(n):
            over = [j for j in range(n) if seq[j] < seq[i] and 0 <= ts[i] - ts[j] <= 1000
                    and abs(v[i] - v[j]) > 18.0]
            assert at[i] == (min(over, key=lambda j: seq[j]) if over else -1)


def test_latest_and_history(spark):
    nan = float("nan")
    rows = [("a", 0, 0, 1.0), ("a", 1, 50, 2.0), ("a", 2, 50, 3.0), ("a", 3, 30_050, nan),
            ("b", 4, 1000, 5.0), ("b", 5, 500, 6.0), ("c", 6, 119_000, 5.0), ("c", 7, 149_001, 6.0)]
    frame = spark.createDataFrame(rows, "vin string, seq bigint, sig_ts bigint, v double").select(
        "vin", F.col("sig_ts").alias("kafka_ts"), "sig_ts", "seq", F.lit("speed").alias("sig_name"),
        F.expr("if(isnan(v), cast('NaN' as variant), cast(v as variant))").alias("value"))
    speeds = anomalies.speed_rows(frame)
    latest = {r.vin: (r.sig_ts, r.speed) for r in anomalies.latest_speed(speeds).collect()}
    assert latest["b"] == (1000, 5.0) and latest["a"][0] == 30_050 and np.isnan(latest["a"][1])
    before = {r.vin: (r.sig_ts, r.speed) for r in anomalies.latest_speed(speeds.where("seq < 3")).collect()}
    assert before == {"a": (50, 2.0)}
    for block in (2, 65_536):
        sizes = {r.seq: (r.history_size, r.has_history)
                 for r in anomalies.speed_history_size(speeds, block=block).collect()}
        assert sizes == {0: (1, False), 1: (2, True), 2: (3, True), 3: (3, True), 4: (1, False), 5: (2, True),
                         6: (1, False), 7: (1, False)}
