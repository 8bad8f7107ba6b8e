"""Work that grows with the input is spread over tasks and done once."""

import glob

import numpy as np
import pandas as pd
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from test_speed import TIERS, found, one_by_one, stream_of
from test_streams import CLOSING, batches_of

from roadpulse import rules
from roadpulse.plans import fixtures as fx
from roadpulse.plans import queries
from roadpulse.streaming import run, speed, speed_join, speed_state


def write_events(spark, path, ids):
    rows = spark.createDataFrame([(i,) for i in ids], "event_id bigint").selectExpr(
        "event_id", "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, event_id) as ts",
        "event_id % 5 as user_id", "'view' as event_type", "1D as value", "'{\"k\": 1}' as props")
    rows.coalesce(1).write.parquet(f"{path}/events.parquet")
    return str(path)


@pytest.mark.parametrize("ids", [range(960), [*range(300), *range(900, 960)], [1, 1, None, 2, 959]])
def test_a_batch_is_dealt_over_files(spark, tmp_path, monkeypatch, ids):
    """No file has many rows, and each batch has its own third of the ids, be it without rows."""
    monkeypatch.setattr(fx, "shared_dir", lambda _, purpose: str(tmp_path / purpose))
    stream = fx.event_batches(spark, write_events(spark, tmp_path, ids), closing=True, file_rows=50)
    sizes = [pq.read_metadata(f).num_rows for f in glob.glob(str(tmp_path / "event-batches" / "*.parquet"))]
    assert max(sizes) <= 60
    seen = {}
    run.start(stream, lambda df, n: seen.__setitem__(n, sorted(r.event_id for r in df.collect())),
              str(tmp_path / "c"), every=None).awaitTermination()
    known = [i for i in ids if i is not None]
    low, high = min(known), max(known)
    cuts = [low, *(low + (high + 1 - low) * i // 3 >> 5 << 5 for i in (1, 2)), high + 1]
    want = [sorted(i for i in known if a <= i < b) for a, b in zip(cuts, cuts[1:])] + [[high + 64]]
    assert [seen[n] for n in sorted(seen)] == want


def test_facts_are_judged_once(spark, tmp_path, monkeypatch):
    """Three batches, five tries: the verdicts behind them are worked out a single time."""
    judged = spark.sparkContext.accumulator(0)
    verdicts = queries._verdicts
    count = F.udf(lambda x: judged.add(1) or x, "string").asNondeterministic()
    monkeypatch.setattr(queries, "_verdicts", lambda *a: verdicts(*a).withColumn("trigger_id", count("trigger_id")))
    sf_dir = write_events(spark, tmp_path, range(96))
    n = queries.facts_exactly_once(spark, sf_dir).count()
    assert n > 0 and judged.value == n


def state_sizes(df, path):
    run.use_rocksdb(df.sparkSession)
    query = df.writeStream.format("parquet").option("path", f"{path}/out").option(
        "checkpointLocation", f"{path}/c").trigger(availableNow=True).start()
    query.awaitTermination()
    return [p.stateOperators[0].numRowsTotal for p in query.recentProgress]


def test_a_call_serves_many_vehicles(spark, tmp_path):
    """Calls and rows of the store by deals, not by vehicles; each vehicle is judged by its own rows alone."""
    rows = [(f"v{i % 200}", i, i // 200 * 700 + i % 7, float(i * 13 % 60)) for i in range(1000)]
    # Far-off times beside near ones, and rows too late to meet what has left.
    rows += [("far", 1000, 0, 0.0), ("far", 1001, 1_700_000_000_000, 50.0), ("far", 1002, 500, 50.0),
             ("far", 1003, 1_700_000_000_100, 0.0)]
    sizes = state_sizes(speed.exact(stream_of(spark, tmp_path, rows, 3)), tmp_path / "n")
    assert max(sizes) <= 8 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    got = found(run.drain(speed.exact(stream_of(spark, tmp_path / "b", rows, 3), deals=2), "t-deals"))
    want = one_by_one(rows)
    assert got == want and len(want) > 100


def test_vehicles_side_by_side_as_one_by_one():
    rng = np.random.default_rng(6)
    for _ in range(20):
        n = 200
        ts, v = rng.integers(0, 90_000, n), np.round(rng.uniform(0, 40, n), 1)
        vins = rng.choice(["a", "b", "c"], n)
        rows = [(w, i, int(t), float(x)) for i, (w, t, x) in enumerate(zip(vins, ts, v))]
        frame = pd.DataFrame({"vin": pd.Series(vins, dtype=object), "sig_ts": ts, "seq": range(n), "speed": v})
        kept, got = frame.head(0), []
        for cut in np.array_split(np.arange(n), 4):
            hits, kept = speed_state.judge_vehicles(kept, frame.iloc[cut], TIERS, 30_000, part_rows=30)
            got += [(h.vin, h.seq, rules.SPEED_TIERS[h.tier - 1].anomaly_type, h.previous_seq) for h in hits.itertuples()]
        assert sorted(got) == one_by_one(rows)


def test_joined_slots_hold_many_vehicles(spark, tmp_path):
    """Rows of the stores by deals and slots, not by vehicles; each vehicle meets its own rows alone, one without a name none."""
    rows = [(f"v{i % 200}", i, i // 200 * 700 + i % 7, float(i * 13 % 60)) for i in range(1000)]
    # Several rows of a vehicle in a slot, and a vehicle with none in common with the others' slots.
    rows += [("v3", 1000 + i, 1400 + i % 5, float(i * 17 % 90)) for i in range(40)] + [("alone", 1040, 5000, 0.0)]
    nameless = [(None, 2000 + i, i * 100, float(i % 2 * 50)) for i in range(10)]
    parts = [rows[:300], rows[300:700] + nameless, rows[700:], [CLOSING], [("closing", 10**6 + 1, 2 * 10**7, 0.0)]]
    query = speed_join.joined(batches_of(spark, tmp_path, parts)).writeStream.format("parquet").option(
        "path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True)
    run.use_rocksdb(spark)
    query = query.start()
    query.awaitTermination()
    got = found(spark.read.parquet(str(tmp_path / "out")))
    want = one_by_one(rows)
    assert got == want and len(want) > 100
    # The finds are kept by row; the join and the folds of its two sides are below them.
    sizes = [[s.numRowsTotal for s in p.stateOperators][1:] for p in query.recentProgress]
    deals, slots = 2 * int(spark.conf.get("spark.sql.shuffle.partitions")), len({ts // 250 for _, _, ts, _ in rows + nameless})
    assert max(map(max, sizes)) <= 3 * deals * slots < 2 * 200 * 5


@pytest.mark.parametrize("deals", [1, 7])
def test_joined_by_any_number_of_deals(spark, tmp_path, deals):
    rng = np.random.default_rng(deals)
    rows = [(f"v{int(w)}", i, int(t), float(x)) for i, (w, t, x) in enumerate(zip(
        rng.zipf(1.5, 600) % 40, np.arange(600) * 30 + 5000 - rng.integers(0, 4000, 600), np.round(rng.uniform(0, 40, 600), 1)))]
    got = found(run.drain(speed_join.joined(batches_of(spark, tmp_path, [rows[:250], rows[250:], [CLOSING]]), deals=deals), "t-deals"))
    want = one_by_one(rows)
    assert got == want and len(want) > 100
