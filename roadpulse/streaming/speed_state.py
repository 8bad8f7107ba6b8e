"""One step of the speed state of many vehicles, free of Spark."""

from __future__ import annotations

import numpy as np
import pandas as pd

from roadpulse.functions.speed_search import first_hits


def judge(kept: pd.DataFrame, rows: pd.DataFrame, tiers, retention_ms: int):
    """``judge_vehicles`` for rows of one vehicle, where ``kept`` has no vin."""
    hits, left = judge_vehicles(kept.assign(vin=rows.vin.iloc[0] if len(rows) else None), rows, tiers, retention_ms)
    return hits, left.drop(columns="vin")


def judge_vehicles(kept: pd.DataFrame, rows: pd.DataFrame, tiers, retention_ms: int, part_rows: int = 300_000):
    """Judge ``rows`` (in arrival order) against the rows ``kept`` of their vehicles and each other, all vehicles at once.

    Returns the rows that hit, with tier and the earlier row, and the rows to
    keep. A vehicle's rows are dropped only from the old end: the oldest goes while it is
    more than ``retention_ms`` older than the newcomer, so a newer row in front
    shields older ones behind it.
    """
    n = len(kept)
    group = pd.factorize(pd.concat([kept.vin, rows.vin], ignore_index=True), use_na_sentinel=False)[0]
    order = np.argsort(group, kind="stable")  # vehicle by vehicle, what is kept before what is new
    group, new = group[order], order >= n
    ts = np.r_[kept.sig_ts.to_numpy(), rows.sig_ts.to_numpy()].astype(np.int64)[order]
    seq = np.r_[kept.seq.to_numpy(np.int64), rows.seq.to_numpy(np.int64)][order]
    speed = np.r_[kept.speed.to_numpy(float), rows.speed.to_numpy(float)][order]
    place = np.arange(len(ts))
    begin = np.searchsorted(group, group)

    # A vehicle's head stops at the first row whose running latest time is within retention of the latest
    # newcomer so far. after[i]: first row kept once i came; oldest[i]: first row still kept when newcomer i is judged.
    latest = _running_max(ts, group)
    at = np.flatnonzero(new)
    limit_ts = _running_max(ts[at], group[at]) - retention_ms
    ranks = np.unique(np.r_[latest, limit_ts], return_inverse=True)[1]
    step = int(ranks.max(initial=0)) + 1
    after = begin.copy()
    after[at] = np.searchsorted(group * step + ranks[:len(ts)], group[at] * step + ranks[len(ts):], "left")
    oldest = np.where(place == begin, begin, np.r_[0, after[:-1]]) if len(ts) else begin
    ends = np.searchsorted(group, group, "right") - 1
    stays = place >= after[ends]

    tier_of = np.zeros(len(ts), dtype=np.int32)
    prev = np.full(len(ts), -1, dtype=np.int64)
    near = _without_gaps(ts, group, max(t[1] for t in tiers))
    for tier, range_ms, limit in tiers:
        mine, _, found = first_hits(group, near, place, speed, new & (prev < 0), [(tier, range_ms, limit)], part_rows)
        # A row found but already dropped: very late newcomers only, so look through what is left.
        for i in np.flatnonzero(found < oldest[mine]):
            row = mine[i]
            left = slice(oldest[row], row)
            age = ts[row] - ts[left]
            over = (age >= 0) & (age <= range_ms) & (np.abs(speed[row] - speed[left]) > limit)
            found[i] = oldest[row] + np.argmax(over) if over.any() else -1
        hit = found >= 0
        tier_of[mine[hit]], prev[mine[hit]] = tier, found[hit]

    hit = np.flatnonzero(prev >= 0)
    hit = hit[np.argsort(order[hit])]
    hits = rows.iloc[order[hit] - n].assign(
        tier=tier_of[hit], previous_seq=seq[prev[hit]],
        previous_ts=ts[prev[hit]], previous_speed=speed[prev[hit]],
    )
    vin = np.r_[kept.vin.to_numpy(object), rows.vin.to_numpy(object)][order]
    left = pd.DataFrame({"vin": vin[stays], "sig_ts": ts[stays], "seq": seq[stays], "speed": speed[stays]})
    return hits, left


def _running_max(values: np.ndarray, group: np.ndarray) -> np.ndarray:
    return pd.Series(values).groupby(group).cummax().to_numpy(np.int64)


def _without_gaps(ts: np.ndarray, group: np.ndarray, reach: int) -> np.ndarray:
    """Times whose gaps of more than ``reach`` are ``reach + 1``, so that a vehicle's far-off times cost the search no
    room: who is within reach of whom, and how far, stays."""
    by_time = np.lexsort((ts, group))
    gaps = np.diff(ts[by_time], prepend=ts[by_time[:1]])
    gaps[(gaps < 0) | (gaps > reach)] = reach + 1
    near = np.empty_like(ts)
    near[by_time] = np.cumsum(gaps)
    return near
