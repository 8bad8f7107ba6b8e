"""The speed rule inside a task: for many vehicles and time buckets at once, the first earlier arrival over a limit."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from roadpulse.functions.first_hit import first_hit


def first_hits(group, ts, seq, speed, judged, tiers, part_rows: int):
    """(rows, tier, previous row): the judged rows that hit, tier by tier, against rows of their own group.

    ``group`` numbers are 0, 1, 2, ... in any order of rows. A row is compared with rows of smaller seq, so
    rows that repeat one seq don't meet. Groups of more than ``part_rows`` rows are cut by seq.
    """
    sizes = np.bincount(group)
    tier_of, prev = np.zeros(len(ts), np.int32), np.full(len(ts), -1)
    small = sizes[group] <= part_rows
    if small.any():
        _search(np.flatnonzero(small), group, ts, seq, speed, judged, tiers, tier_of, prev)
    for g in np.flatnonzero(sizes > part_rows):
        rows = np.flatnonzero(group == g)
        rows = rows[np.argsort(seq[rows], kind="stable")]
        _search_parts(rows, ts, seq, speed, judged, tiers, part_rows, tier_of, prev)
    hit = np.flatnonzero(prev >= 0)
    return hit, tier_of[hit], prev[hit]


def _search(rows, group, ts, seq, speed, judged, tiers, tier_of, prev) -> None:
    """All groups in one search: each gets a stretch of time of its own, further from the next than any look-back."""
    reach = max(t[1] for t in tiers)
    order = rows[np.argsort(group[rows], kind="stable")]
    starts = np.flatnonzero(np.r_[True, group[order][1:] != group[order][:-1]])
    counts = np.diff(np.r_[starts, len(order)])
    low = np.minimum.reduceat(ts[order], starts)
    span = np.maximum.reduceat(ts[order], starts) - low + reach + 1
    lifted = ts[order] + np.repeat(np.r_[0, np.cumsum(span)[:-1]] - low, counts)
    open_ = np.flatnonzero(judged[order])
    for tier, range_ms, limit in tiers:
        at = first_hit(lifted, seq[order], speed[order], lifted[open_], seq[order][open_], speed[order][open_], range_ms, limit)
        hit = at >= 0
        tier_of[order[open_[hit]]], prev[order[open_[hit]]] = tier, order[at[hit]]
        open_ = open_[~hit]


def _search_parts(rows, ts, seq, speed, judged, tiers, part_rows, tier_of, prev) -> None:
    """One crowded group: parts by seq; a row asks the parts up to its own, earliest first, and skips
    those whose times or speeds can hold no hit. The first part that has one has the first arrival."""
    parts = [rows[i:i + part_rows] for i in range(0, len(rows), part_rows)]
    for tier, range_ms, limit in tiers:
        for number, mine in enumerate(parts):
            open_ = mine[judged[mine] & (prev[mine] < 0)]
            for part in parts[:number + 1]:
                if not len(open_):
                    break
                near = (ts[open_] >= ts[part].min()) & (ts[open_] - range_ms <= ts[part].max())
                far = np.maximum(speed[open_] - speed[part].min(), speed[part].max() - speed[open_]) > limit
                asked = open_[near & far]
                at = first_hit(ts[part], seq[part], speed[part], ts[asked], seq[asked], speed[asked], range_ms, limit)
                hit = at >= 0
                tier_of[asked[hit]], prev[asked[hit]] = tier, part[at[hit]]
                open_ = open_[prev[open_] < 0]


def over_sorted(batches: Iterator[pa.RecordBatch], tiers, part_rows: int, by_time: bool = False) -> Iterator[pa.RecordBatch]:
    """Hits of rows sorted by (vin, bucket); the last group of a batch may go on in the next.

    ``by_time`` takes the rows in order of their times, arrival telling only between equal ones.
    """
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if _key(batch, 0) == _key(batch, -1) == _key(held[0], -1):
            continue  # still the same group
        table = pa.Table.from_batches(held).combine_chunks()
        group = _groups(table)
        end = int(np.searchsorted(group, group[-1]))
        yield from _hits(table.slice(0, end), group[:end], tiers, part_rows, by_time)
        held = table.slice(end).combine_chunks().to_batches()
    if held:
        table = pa.Table.from_batches(held).combine_chunks()
        yield from _hits(table, _groups(table), tiers, part_rows, by_time)


def _key(batch: pa.RecordBatch, row: int) -> tuple:
    row %= batch.num_rows
    return batch.column("vin")[row].as_py(), batch.column("bucket")[row].as_py()


def _groups(table: pa.Table) -> np.ndarray:
    """Number of each row's group, counting changes of (vin, bucket)."""
    vin = table.column("vin").combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
    bucket = table.column("bucket").to_numpy()
    return np.cumsum(np.r_[0, (vin[1:] != vin[:-1]) | (bucket[1:] != bucket[:-1])])


def _hits(table: pa.Table, group: np.ndarray, tiers, part_rows: int, by_time: bool) -> Iterator[pa.RecordBatch]:
    if not len(group):
        return
    ts, seq = table.column("sig_ts").to_numpy(), table.column("seq").to_numpy()
    speed, owner = table.column("speed").to_numpy(), table.column("owner").to_numpy(zero_copy_only=False)
    place = seq
    if by_time:
        place = np.empty(len(seq), np.int64)
        place[np.lexsort((seq, ts))] = np.arange(len(seq))
    rows, tier, prev = first_hits(group, ts, place, speed, owner, tiers, part_rows)
    if not len(rows):
        return
    found = table.select(["vin", "kafka_ts", "sig_ts", "seq", "sig_name", "speed"]).take(pa.array(rows))
    for name, values in (("tier", pa.array(tier, pa.int32())), ("previous_seq", pa.array(seq[prev])),
                         ("previous_ts", pa.array(ts[prev])), ("previous_speed", pa.array(speed[prev]))):
        found = found.append_column(name, values)
    yield from found.combine_chunks().to_batches()
