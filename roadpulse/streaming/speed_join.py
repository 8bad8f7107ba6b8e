"""The speed rule as a join of the stream with itself, without Python.

Both sides are the same speed rows, folded into small time slots as the watermark closes them. A slot holds the rows of a
deal of vehicles, side by side, so that the stores of the folds and of the join have a row per deal and not per vehicle. A
slot is joined with those of the last two seconds, and the vehicles that are in both meet there. Where a slot lies
within a tier's range as a whole, only a vehicle's running extremes can be the first arrival over the limit, so each row
meets those few; only the slots at the two ends of a range are looked through row by row. What the pairs of slots find
comes together per row, first tier and first arrival first.

Results come once the watermark has passed, so a stream needs a later row, or ``closing`` rows, to give its last ones.
Rows later than the watermark's delay are dropped, as a join of streams does; ``speed.exact_by_slot`` drops none.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadpulse import rules
from roadpulse.operators.anomalies import speed_anomalies_of, speed_rows
from roadpulse.streaming.speed import LATENESS, with_event_time

# The rows of a vehicle in a slot, in order of arrival, that are the highest or the lowest so far.
EXTREMES = """if(size(v.rows) = 1, v.rows, aggregate(v.rows,
    named_struct('kept', slice(v.rows, 1, 0), 'high', cast('-Infinity' as double), 'low', cast('Infinity' as double)),
    (s, r) -> named_struct(
      'kept', if(r.speed > s.high or r.speed < s.low, concat(s.kept, array(r)), s.kept),
      'high', greatest(s.high, r.speed), 'low', least(s.low, r.speed)),
    s -> s.kept))"""

# Rows (vin, seq, ...) in order as an array of (vin, rows), in order too: cut wherever another vehicle begins. A value that
# is used many times over is bound to a name by a transform of one element.
VEHICLES = """transform(array(sort_array(rows)), r -> transform(
    array(filter(sequence(0, size(r) - 1), i -> i = 0 or not r[i].vin <=> get(r, i - 1).vin)), cuts -> transform(
      cuts, (c, k) -> struct(r[c].vin as vin, transform(
        slice(r, c + 1, coalesce(get(cuts, k + 1), size(r)) - c), x -> struct({columns})) as rows)))[0])[0]"""

# The vehicles that are in both of two slots, as (own, past). Each is there once at most, so in the order of both together
# its past comes right before its own.
IN_BOTH = """transform(array(sort_array(concat(
      transform(past_vehicles, (v, k) -> struct(v.vin as vin, 0 as own, k as k)),
      transform(vehicles, (v, k) -> struct(v.vin as vin, 1 as own, k as k))))), m -> transform(
    filter(sequence(1, size(m) - 1), i -> m[i].vin = m[i - 1].vin),
    i -> struct(vehicles[m[i].k] as own, past_vehicles[m[i - 1].k] as past)))[0]"""


def slots(speeds: DataFrame, slot_ms: int, deals: int, columns: Sequence[str]) -> DataFrame:
    """Rows per deal of vehicles and slot: deal, slot, slot_time, vehicles; a vehicle is its vin and rows by arrival."""
    split = VEHICLES.format(columns=", ".join(f"x.{c}" for c in columns))
    return (
        speeds.groupBy(F.pmod(F.xxhash64("vin"), F.lit(deals)).alias("deal"),
                       F.window("sig_time", f"{slot_ms} milliseconds").alias("w"))
        .agg(F.collect_list(F.struct("vin", *columns)).alias("rows"))
        .select("deal", (F.unix_millis("w.start") / slot_ms).cast("bigint").alias("slot"),
                F.window_time("w").alias("slot_time"), F.expr(split).alias("vehicles"))
    )


def _tier_hit(tier: rules.SpeedTier, slot_ms: int) -> str:
    """The first earlier arrival of the other slot in range and over the limit, with the tier's number; null if none."""
    # The other slot is wholly in range if it ends before this one begins and begins within the range of this one's end.
    whole = f"slot > past_slot and (slot - past_slot + 1) * {slot_ms}L <= {tier.range_ms}"
    over = f"r.seq < c.seq and abs(c.speed - r.speed) > {tier.limit}D"
    near = f"r.sig_ts between c.sig_ts - {tier.range_ms} and c.sig_ts"
    found = f"get(if({whole}, filter(extremes, r -> {over}), filter(past_rows, r -> {over} and {near})), 0)"
    reach = f"(slot - past_slot - 1) * {slot_ms}L < {tier.range_ms}"
    return (f"if({reach}, transform(array({found}), f -> if(f is null, null, named_struct('tier', {tier.tier},"
            f" 'previous_seq', f.seq, 'previous_ts', f.sig_ts, 'previous_speed', f.speed)))[0], null)")


def joined(
    df: DataFrame,
    tiers: Sequence[rules.SpeedTier] = tuple(rules.SPEED_TIERS),
    slot_ms: int = 250,
    bucket_ms: int = 10_000,
    delay: str = LATENESS,
    deals: int | None = None,
) -> DataFrame:
    """Speed anomalies of a stream, for rows up to ``delay`` late.

    Vehicles are dealt by hash over ``deals`` (twice the session's shuffle partitions, if not given); raise it with
    the fleet, so that a deal's slot stays small. Slots meet by (deal, bucket), the last of a bucket in the next one too,
    so the state of a vehicle that sends a third of the feed moves on to another task every ``bucket_ms``. State is bounded
    by the watermark on every level: rows of open slots, slots of the last seconds, and finds of rows that are still open.
    """
    reach = max(t.range_ms for t in tiers)
    if bucket_ms % slot_ms or reach + slot_ms > bucket_ms:
        raise ValueError("a bucket must be whole slots and longer than the look-back")
    per_bucket, look_back = bucket_ms // slot_ms, -(-reach // slot_ms)

    deals = deals or 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def side(*columns: str) -> DataFrame:
        rows = speed_rows(with_event_time(df, delay), ["sig_time"]).where("not isnan(speed)")
        return slots(rows, slot_ms, deals, columns)

    own = side("seq", "sig_ts", "speed", "kafka_ts").withColumn("bucket", F.expr(f"floor(slot / {per_bucket}D)"))
    spread = f"floor(slot / {per_bucket}D), floor((slot + {look_back}) / {per_bucket}D)"
    past = side("seq", "sig_ts", "speed").select(
        F.col("deal").alias("past_deal"), F.col("slot").alias("past_slot"), F.col("slot_time").alias("past_time"),
        F.expr(f"transform(vehicles, v -> struct(v.vin, v.rows, {EXTREMES} as extremes))").alias("past_vehicles"),
        F.explode(F.expr(f"array_distinct(array({spread}))")).alias("past_bucket"))
    pairs = own.join(past, F.expr(
        f"deal = past_deal and bucket = past_bucket and past_time <= slot_time"
        f" and past_time >= slot_time - interval {look_back * slot_ms} milliseconds"))
    met = pairs.select("slot", "slot_time", "past_slot", F.explode(F.expr(IN_BOTH)).alias("v")).select(
        "slot", "slot_time", "past_slot", "v.own.vin", "v.own.rows", F.col("v.past.rows").alias("past_rows"), "v.past.extremes")

    hit = f"coalesce({', '.join(_tier_hit(t, slot_ms) for t in sorted(tiers))})"
    finds = f"filter(transform(rows, (c, i) -> struct(i as nth, c as c, {hit} as hit)), x -> x.hit is not null)"
    found = met.select("vin", "slot_time", F.explode(F.expr(finds)).alias("x")).select(
        "vin", "slot_time", "x.nth", "x.c.*", "x.hit")
    first = found.groupBy(
        F.window("slot_time", f"{slot_ms} milliseconds"), "vin", "nth", "seq", "kafka_ts", "sig_ts", "speed",
    ).agg(F.min("hit").alias("hit"))
    hits = first.select("vin", "kafka_ts", "sig_ts", "seq", F.lit(rules.SPEED_SIGNAL).alias("sig_name"), "speed", "hit.*")
    return speed_anomalies_of(hits, tiers)
