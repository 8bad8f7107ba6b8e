"""The speed rule on a stream, in two forms that judge rows in arrival order at once and drop none.

``exact`` keeps each vehicle's recent rows as one state. ``judge_by_slot`` and ``exact_by_slot`` have a
state per time slot and deal of vehicles, for feeds where one vehicle sends a large part of the rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from roadpulse import rules
from roadpulse.functions import first_hit, speed_search
from roadpulse.operators.anomalies import HIT_SCHEMA, speed_anomalies_of, speed_rows
from roadpulse.operators.timebuckets import with_lookback
from roadpulse.streaming import speed_state

# Send the state step to the executors with the task, so they need no copy of this package.
cloudpickle.register_pickle_by_value(first_hit)
cloudpickle.register_pickle_by_value(speed_search)
cloudpickle.register_pickle_by_value(speed_state)

# Fixed value: how late a row may be.
LATENESS = "20 seconds"


def with_event_time(df: DataFrame, delay: str = LATENESS) -> DataFrame:
    """Add ``sig_time`` with a watermark of ``delay``."""
    return df.withColumn("sig_time", F.timestamp_millis("sig_ts")).withWatermark("sig_time", delay)


HIT_COLUMNS = ["vin", "kafka_ts", "sig_ts", "seq", "sig_name", "speed",
               "tier", "previous_seq", "previous_ts", "previous_speed"]
KEPT = ["sig_ts", "seq", "speed"]
STATE_SCHEMA = "vin array<string>, sig_ts array<bigint>, seq array<bigint>, speed array<double>, seen array<bigint>"
STATE_KINDS = {"vin": object, "sig_ts": "int64", "seq": "int64", "speed": "float64", "seen": "int64"}


def exact(
    df: DataFrame,
    tiers: Sequence[rules.SpeedTier] = tuple(rules.SPEED_TIERS),
    retention_ms: int = rules.SPEED_RETENTION_MS,
    idle_ms: int | None = None,
    deals: int | None = None,
) -> DataFrame:
    """Speed anomalies in exact arrival order, from per-vehicle state of ``retention_ms``.

    The rows of a micro-batch are taken in ``seq`` order; bound a micro-batch at
    the source. ``idle_ms`` drops the state of vehicles silent for that long.

    The states of a deal of vehicles lie side by side in one row of the store and are judged by one call into Python, as
    a call costs some ms and must serve many vehicles. Vehicles are dealt by hash over ``deals``
    (eight times the session's shuffle partitions, if not given); raise it with the fleet, so that a deal stays small.
    """
    plan = [(t.tier, t.range_ms, t.limit) for t in tiers]
    names, kinds, step = HIT_COLUMNS, STATE_KINDS, speed_state.judge_vehicles
    kept_names = ["vin", *KEPT]
    deals = deals or 8 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def advance(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.getCurrentProcessingTimeMs() if idle_ms else 0
        held = state.get if state.exists else ([],) * 5
        kept = pd.DataFrame({c: pd.Series(list(v), dtype=kind) for (c, kind), v in zip(kinds.items(), held)})
        rows = None if state.hasTimedOut else pd.concat(list(frames)).sort_values("seq", kind="stable")
        if idle_ms:
            stays = kept.seen + idle_ms > now
            kept = kept[stays if rows is None else stays | kept.vin.isin(rows.vin)]
        if rows is None:
            hits = ()
        else:
            # Only vehicles that send have new rows to judge or old ones to drop.
            sends = kept.vin.isin(rows.vin)
            silent = kept[~sends]
            hits, left = step(kept.loc[sends, kept_names], rows, plan, retention_ms)
            kept = pd.concat([silent, left.assign(seen=now)]) if len(silent) else left.assign(seen=now)
        if len(kept):
            state.update(tuple(kept[c].tolist() for c in kinds))
            if idle_ms:
                state.setTimeoutDuration(max(1, int(kept.seen.min()) + idle_ms - now))
        elif state.exists:
            state.remove()
        if len(hits):
            yield hits[names]

    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout
    speeds = speed_rows(df).where("not isnan(speed)")
    hits = speeds.withColumn("deal", F.pmod(F.xxhash64("vin"), F.lit(deals))).groupBy("deal").applyInPandasWithState(
        advance, HIT_SCHEMA, STATE_SCHEMA, "append", timeout
    )
    return speed_anomalies_of(hits, tiers)


JUDGED_SCHEMA = HIT_SCHEMA + ", late_ms bigint, reason string"
SLOT_STATE = "vin array<string>, sig_ts array<bigint>, seq array<bigint>, speed array<double>, mark array<bigint>"
SLOT_KEPT_COLUMNS = ["vin", *KEPT, "mark"]
# Fixed value: a row this much older than the newest of the batches before may have lost rows it could hit.
SOUND = "28 seconds"
SLOT_KEPT, SLOT_GONE = "slot_kept", "slot_gone"


def judge_by_slot(
    df: DataFrame,
    tiers: Sequence[rules.SpeedTier] = tuple(rules.SPEED_TIERS),
    retention_ms: int = rules.SPEED_RETENTION_MS,
    slot_ms: int = 10_000,
    part_rows: int = 300_000,
    delay: str = SOUND,
    deals: int | None = None,
) -> DataFrame:
    """Hits of the speed rule and late rows, from one pass over one small state per time slot and deal of vehicles.

    A row with ``tier`` is a hit. A row with ``reason`` is a row that was late: older than the watermark, which is
    ``delay`` behind the newest time of the batches before, by ``late_ms``. ``slot_kept`` says that its slot still had
    rows of its vehicle, ``slot_gone`` that it had none or they had left, so that hits may be missing. No row is dropped.

    Vehicles are dealt by hash over ``deals`` (twice the session's shuffle partitions, if not given), as a call into Python
    costs some ms and must serve many vehicles; raise it with the fleet, so that a deal's slot stays small.
    A slot has its deal's rows of ``slot_ms`` and of the look-back in the slot before; a batch reads and writes
    the slots that its rows are in and no others. A vehicle's rows leave a slot ``retention_ms`` after the watermark has
    passed its end and what it was when the last of them came; the slot itself leaves by a timer, without new rows. Only the times in the feed count for that: a stream that was down for hours goes on as if it had
    not been. A vehicle that sends a third of a live feed moves on to another state every ``slot_ms``.
    """
    plan = [(t.tier, t.range_ms, t.limit) for t in tiers]
    reach = max(t.range_ms for t in tiers)
    names, search = HIT_COLUMNS, speed_search.first_hits
    out_names, kept_names = [*names, "late_ms", "reason"], SLOT_KEPT_COLUMNS
    deals = deals or 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def advance(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        mark, end = state.getCurrentWatermarkMs(), (int(key[1]) + 1) * slot_ms
        if state.hasTimedOut:
            state.remove()
            return
        new = pd.concat(list(frames), ignore_index=True).assign(mark=mark)
        both, n = new[kept_names], 0
        if state.exists:
            old = pd.DataFrame(dict(zip(kept_names, map(np.asarray, state.get))))
            # Rows of a vehicle stay or leave together.
            old = old[old.groupby("vin", dropna=False).mark.transform("max").clip(lower=end) + retention_ms > mark]
            both, n = pd.concat([old, both], ignore_index=True), len(old)
        ts = both.sig_ts.to_numpy(np.int64)
        owner = new.owner.to_numpy(bool)
        at, tier, prev = search(
            pd.factorize(both.vin, use_na_sentinel=False)[0], ts, both.seq.to_numpy(np.int64), both.speed.to_numpy(float),
            np.r_[np.zeros(n, bool), owner], plan, part_rows)
        state.update(tuple(both[c].tolist() for c in kept_names))
        state.setTimeoutTimestamp(max(end, mark) + retention_ms)

        late = owner & (ts[n:] < mark)
        if len(at):
            past = both.iloc[prev]
            yield new.iloc[at - n].assign(
                tier=tier, previous_seq=past.seq.to_numpy(), previous_ts=past.sig_ts.to_numpy(),
                previous_speed=past.speed.to_numpy(), late_ms=None, reason=None)[out_names]
        if late.any():
            kind = np.where(new.vin[late].isin(both.vin[:n]), SLOT_KEPT, SLOT_GONE)
            yield new[late].assign(
                tier=None, previous_seq=None, previous_ts=None, previous_speed=None, late_ms=mark - ts[n:][late],
                reason=kind)[out_names]

    timed = speed_rows(with_event_time(df, delay), ["sig_time"]).where("not isnan(speed)").drop("sig_time")
    near = with_lookback(timed, "sig_ts", slot_ms, reach).withColumnRenamed("bucket", "slot")
    # Timers by the watermark leave out rows whose event time is behind it. A column without a time takes the place of the
    # event time, so that no row is; the watermark itself comes from sig_time above.
    near = near.withColumn("never_late", F.lit(None).cast("timestamp")).withMetadata("never_late", {"spark.watermarkDelayMs": 0})
    return near.withColumn("deal", F.pmod(F.xxhash64("vin"), F.lit(deals))).groupBy("deal", "slot").applyInPandasWithState(
        advance, JUDGED_SCHEMA, SLOT_STATE, "append", GroupStateTimeout.EventTimeTimeout)


def exact_by_slot(df: DataFrame, tiers: Sequence[rules.SpeedTier] = tuple(rules.SPEED_TIERS), **tuning) -> DataFrame:
    """Speed anomalies as ``exact`` gives them, with state that spreads over time slots: see ``judge_by_slot``."""
    return speed_anomalies_of(judge_by_slot(df, tiers, **tuning).where("tier is not null"), tiers)


def late_rows(judged: DataFrame) -> DataFrame:
    """The late rows of ``judge_by_slot``: vin, seq, sig_ts, speed, late_ms, reason."""
    return judged.where("reason is not null").select("vin", "seq", "sig_ts", "speed", "late_ms", "reason")


def hits_and_late(
    write_hits: Callable[[DataFrame, int], None], write_late: Callable[[DataFrame, int], None],
    tiers: Sequence[rules.SpeedTier] = tuple(rules.SPEED_TIERS),
) -> Callable[[DataFrame, int], None]:
    """A batch writer for ``judge_by_slot``: anomalies to one place, late rows to another, from one pass."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            write_hits(speed_anomalies_of(batch.where("tier is not null"), tiers), batch_id)
            write_late(late_rows(batch), batch_id)
        finally:
            batch.unpersist()

    return write
