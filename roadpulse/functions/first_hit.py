"""First earlier arrival whose speed differs too much, for many rows at once.

Used inside tasks for vehicle-and-time buckets too dense to compare row by row.
The cost is O(n log^2 n) for n rows, however many pairs exceed the limit.
"""

from __future__ import annotations

import numpy as np

# Up to this many comparisons a plain table of them is faster than the search.
SMALL = 100_000


def _window_extremes(node, ts, rank, q_node, q_ts, reach):
    """Per query: is any row of its node in [q_ts - reach, q_ts], their top and bottom rank.

    Rows come sorted by (node, ts). Time is cut into blocks of ``reach`` ms, so
    an interval is a tail of one block plus a head of the next; extremes running
    from both block ends answer every query without a scan.
    """
    step = len(ts) + 1
    span = int(max(ts.max(), q_ts.max())) + 1
    key = node * span + ts
    a = np.searchsorted(key, q_node * span + np.maximum(q_ts - reach, 0), "left")
    b = np.searchsorted(key, q_node * span + q_ts, "right")
    per_node = span // reach + 2
    block = node * per_node + ts // reach + 1
    q_block = q_node * per_node + q_ts // reach + 1

    # Running extremes that restart at each block: the block number leads the compared value.
    order = np.cumsum(np.r_[0, block[1:] != block[:-1]])
    back = order[-1] - order
    low = len(ts) - rank
    head_hi = np.maximum.accumulate(order * step + rank) - order * step
    head_lo = len(ts) - (np.maximum.accumulate(order * step + low) - order * step)
    tail_hi = np.maximum.accumulate((back * step + rank)[::-1])[::-1] - back * step
    tail_lo = len(ts) - (np.maximum.accumulate((back * step + low)[::-1])[::-1] - back * step)

    some = b > a
    first, last = np.where(some, a, 0), np.where(some, b - 1, 0)
    in_head = some & (block[last] == q_block)
    in_tail = some & (block[first] == q_block - 1)
    hi = np.maximum(np.where(in_head, head_hi[last], -1), np.where(in_tail, tail_hi[first], -1))
    lo = np.minimum(np.where(in_head, head_lo[last], step), np.where(in_tail, tail_lo[first], step))
    return some, hi, lo


def first_hit(ts, seq, speed, q_ts, q_seq, q_speed, reach: int, limit: float) -> np.ndarray:
    """Row number of the first arrival within ``reach`` ms before each query and over ``limit``, or -1.

    A row is before a query if it arrived earlier (smaller seq) and its time is
    in [q_ts - reach, q_ts]. The search halves the arrival order: a query goes
    to the earlier half if any row there is over the limit, else to the later.
    """
    found = np.full(len(q_ts), -1, dtype=np.int64)
    if len(ts) == 0 or len(q_ts) == 0:
        return found
    arrival = np.argsort(seq, kind="stable")
    if len(ts) * len(q_ts) <= SMALL:
        age = q_ts[:, None] - ts[arrival]
        with np.errstate(invalid="ignore"):
            over = np.abs(q_speed[:, None] - speed[arrival]) > limit
        over &= (age >= 0) & (age <= reach) & (seq[arrival] < q_seq[:, None])
        hit = over.any(axis=1)
        found[hit] = arrival[over[hit].argmax(axis=1)]
        return found
    base = min(ts.min(), q_ts.min())
    ts, speed, q_ts = ts[arrival] - base, speed[arrival], q_ts - base
    levels, rank = np.unique(speed, return_inverse=True)
    by_time = np.argsort(ts, kind="stable")

    def over(size, queries, nodes):
        picked = by_time[np.argsort(by_time // size, kind="stable")]
        some, hi, lo = _window_extremes(
            picked // size, ts[picked], rank[picked], nodes, q_ts[queries], reach
        )
        mine = q_speed[queries]
        with np.errstate(invalid="ignore"):
            above = levels[np.clip(hi, 0, len(levels) - 1)] - mine > limit
            below = mine - levels[np.clip(lo, 0, len(levels) - 1)] > limit
        return some & (above | below)

    size = 1 << max(len(ts) - 1, 0).bit_length()
    active = np.arange(len(q_ts))
    node = np.zeros(len(q_ts), dtype=np.int64)
    hit = over(size, active, node)
    active, node = active[hit], node[hit]
    while size > 1 and len(active):
        size //= 2
        node = node * 2
        node = node + ~over(size, active, node)
    earlier = seq[arrival[node]] < q_seq[active]
    found[active[earlier]] = arrival[node[earlier]]
    return found
