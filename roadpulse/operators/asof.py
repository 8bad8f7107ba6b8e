"""Look up, for each row, a value among the earlier rows of another table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadpulse.operators.timebuckets import bucket_of

HOUR_MS = 3_600_000
# Points in time that one row of the looked-up side holds at most.
POINTS = 256


def validity(
    right: DataFrame, key: str, right_ts: str, value: Column, best: str, bucket_ms: int = HOUR_MS, points: int = POINTS,
) -> DataFrame:
    """The best value so far as a function of time: rows (_k, _from, _to, _points) that hold from ``_from`` until before ``_to``.

    ``_points`` has up to ``points`` (time, best value from then on), sorted; the row of a key's last points has no ``_to``.
    The running best and the numbers of the points are worked out within (key, time bucket), from one carried row per
    bucket, so a key with a third of the rows spreads over its buckets, and no array grows with a key's history.
    """
    pick, better = (F.min, F.least) if best == "min" else (F.max, F.greatest)
    known = right.where(F.col(key).isNotNull() & F.col(right_ts).isNotNull()).select(
        F.col(key).alias("_k"), bucket_of(right_ts, bucket_ms).alias("_b"), F.col(right_ts).alias("_t"), value.alias("_v"))
    at_time = known.groupBy("_k", "_b", "_t").agg(pick("_v").alias("_v"))
    earlier = Window.partitionBy("_k").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carried = at_time.groupBy("_k", "_b").agg(pick("_v").alias("_v"), F.count(F.lit(1)).alias("_n")).select(
        F.col("_k").alias("_ck"), F.col("_b").alias("_cb"), pick("_v").over(earlier).alias("_before"),
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_passed"))
    inside = Window.partitionBy("_k", "_b").orderBy("_t")
    so_far = at_time.withColumns({"_best": pick("_v").over(inside), "_place": F.row_number().over(inside) - 1})
    numbered = so_far.join(carried, (F.col("_k") == F.col("_ck")) & (F.col("_b") == F.col("_cb"))).select(
        "_k", "_t", better("_best", "_before").alias("_v"),
        F.floor((F.col("_passed") + F.col("_place")) / points).alias("_chunk"))
    chunks = numbered.groupBy("_k", "_chunk").agg(F.array_sort(F.collect_list(F.struct("_t", "_v"))).alias("_points"))
    begins = F.col("_points")[0]["_t"]
    return chunks.select("_k", begins.alias("_from"), F.lead(begins).over(Window.partitionBy("_k").orderBy("_chunk")).alias("_to"),
                         "_points")


def lookup_before(
    left: DataFrame,
    right: DataFrame,
    key: str,
    left_ts: str,
    right_ts: str,
    value: Column,
    best: str,
    out: str,
    bucket_ms: int = HOUR_MS,
    points: int = POINTS,
) -> DataFrame:
    """Add to each left row the ``best`` ("min" or "max") ``value`` of right rows with the same
    key and ``right_ts <= left_ts``; null if there is none. ``value`` is an ordered struct.

    The left side is read once and meets the right side's ``validity``, of which a left row fits one row at most: no
    pairs are formed. Spark sends that side to all tasks while it is small, so that the left side doesn't move; else
    both meet by key, and a key with a third of the left rows, or rows without a key, can be split by it.
    """
    lasting = validity(right, key, right_ts, value, best, bucket_ms, points)
    fits = (F.col(key) == F.col("_k")) & (F.col(left_ts) >= F.col("_from")) & (
        F.col("_to").isNull() | (F.col(left_ts) < F.col("_to")))
    upto = F.filter("_points", lambda p: p["_t"] <= F.col(left_ts))
    return left.join(lasting, fits, "left").select(
        *[left[c] for c in left.columns], F.try_element_at(upto, F.lit(-1))["_v"].alias(out))
