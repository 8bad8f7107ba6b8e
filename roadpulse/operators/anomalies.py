"""Anomaly rules over vehicle signals.

Input frames have vin, kafka_ts, sig_ts (epoch ms), seq (arrival order, unique
per vin), sig_name and value (variant). The system rules look at one row at a
time and run unchanged on a stream; the speed rule compares rows of a vehicle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadpulse import rules
from roadpulse.functions import first_hit, speed_search
from roadpulse.functions.literals import literal_map
from roadpulse.functions.once import with_once
from roadpulse.operators.timebuckets import with_lookback
from roadpulse.schemas import ANOMALY_COLUMNS
from roadpulse.sources.signals import coerce_values

# Send the search to the executors with the task, so they need no copy of this package.
cloudpickle.register_pickle_by_value(first_hit)
cloudpickle.register_pickle_by_value(speed_search)


def speed_rows(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Speed rows: vin, kafka_ts, sig_ts, seq, sig_name, speed, and the columns to ``keep``.

    A value with no double reading is neither judged nor remembered. NaN is
    remembered; it can never exceed a limit.
    """
    typed = coerce_values(df.where(F.col("sig_name") == rules.SPEED_SIGNAL), targets=("as_double",))
    return typed.select(
        "vin", "kafka_ts", "sig_ts", "seq", "sig_name", F.col("as_double").alias("speed"), *keep
    ).where("speed is not null")


HIT_SCHEMA = (
    "vin string, kafka_ts bigint, sig_ts bigint, seq bigint, sig_name string, speed double, "
    "tier int, previous_seq bigint, previous_ts bigint, previous_speed double"
)


def speed_hits(
    speeds: DataFrame,
    tiers: Sequence[rules.SpeedTier] = tuple(rules.SPEED_TIERS),
    bucket_ms: int = 10_000,
    part_rows: int = 300_000,
    order: str = "arrival",
) -> DataFrame:
    """Per speed row the first earlier arrival in range and over the limit, tier by tier.

    ``order="event"`` takes rows in order of their times instead, and arrival between equal ones: a row that comes late
    is judged by what was before it on the road, and is itself in the past of rows that came before it.

    ``speeds`` has vin, kafka_ts, sig_ts, seq, sig_name, speed. Rows shuffle once,
    by vehicle and time bucket, and a task searches all its buckets together;
    a crowded bucket is searched in parts of ``part_rows``. Every row is judged,
    so a row that arrives twice hits twice; rows of one seq are not compared.
    """
    if order not in ("arrival", "event"):
        raise ValueError(f"order must be 'arrival' or 'event', not {order!r}")
    by_time = order == "event"
    reach = max(t.range_ms for t in tiers)
    plan = [(t.tier, t.range_ms, t.limit) for t in tiers]
    speeds = speeds.where("not isnan(speed)")
    search = speed_search.over_sorted
    near = with_lookback(speeds, "sig_ts", bucket_ms, reach).repartition("vin", "bucket")
    return near.sortWithinPartitions("vin", "bucket").mapInArrow(
        lambda batches: search(batches, plan, part_rows, by_time), HIT_SCHEMA
    )


def speed_anomalies_of(hits: DataFrame, tiers: Sequence[rules.SpeedTier]) -> DataFrame:
    """Anomaly rows for speed hits; the texts come from the tier list."""

    def pick(field: str) -> Column:
        branches = [F.when(F.col("tier") == t.tier, F.lit(getattr(t, field))) for t in tiers]
        return F.coalesce(*branches)

    diff = F.abs(F.col("speed") - F.col("previous_speed"))
    return hits.select(
        "vin", "kafka_ts", "sig_ts", "seq",
        pick("anomaly_type").alias("anomaly_type"),
        pick("severity").alias("severity"),
        pick("description").alias("description"),
        "sig_name",
        diff.cast("string").alias("current_value"),
        pick("limit").cast("string").alias("threshold_value"),
        F.lit("decimal").alias("value_type"),
        F.format_string(
            rules.SPEED_DETAIL, "previous_speed", "speed", F.col("sig_ts") - F.col("previous_ts")
        ).alias("additional_info"),
        F.col("speed").alias("current_speed"),
        "previous_speed", "previous_seq",
    )


def speed_change(
    df: DataFrame, tiers: Sequence[rules.SpeedTier] = tuple(rules.SPEED_TIERS), **tuning
) -> DataFrame:
    """Sudden speed changes. Exact for rows up to 28 s late, whatever their order."""
    return speed_anomalies_of(speed_hits(speed_rows(df), tiers, **tuning), tiers)


def system_signals(
    df: DataFrame, system_rules: Sequence[rules.SystemRule] = tuple(rules.SYSTEM_RULES)
) -> DataFrame:
    """System interventions: the signal has a rule and its value reads as true."""
    table = literal_map({r.sig_name: r._asdict() for r in system_rules})
    # The name filter reaches the scan, and only flags that have a rule are typed.
    wanted = df.where(F.col("sig_name").isin([r.sig_name for r in system_rules]))
    fired = coerce_values(wanted, targets=("as_boolean", "as_string")).where("as_boolean")
    return fired.withColumn("rule", F.try_element_at(table, F.col("sig_name"))).select(
        "vin", "kafka_ts", "sig_ts", "seq",
        "rule.anomaly_type", "rule.severity", "rule.description", "sig_name",
        F.col("as_string").alias("current_value"),
        F.lit("true").alias("threshold_value"),
        "value_type",
        "rule.additional_info",
        F.lit(None).cast("double").alias("current_speed"),
        F.lit(None).cast("double").alias("previous_speed"),
        F.lit(None).cast("bigint").alias("previous_seq"),
    )


def vehicle_anomalies(df: DataFrame, **tuning) -> DataFrame:
    """Speed and system anomalies as one frame; each branch filters its own signal names."""
    return speed_change(df, **tuning).unionByName(system_signals(df)).select(*ANOMALY_COLUMNS)


def recent_anomalies(anomalies: DataFrame, n: int) -> DataFrame:
    """The newest ``n`` anomalies."""
    return anomalies.orderBy(F.desc("sig_ts"), "vin", "anomaly_type", "seq").limit(n)


def latest_speed(speeds: DataFrame) -> DataFrame:
    """Latest speed per vehicle; of equal times the first arrival stays."""
    order = F.struct("sig_ts", (-F.col("seq")).alias("_earlier"))
    latest = F.max_by(F.struct("sig_ts", "speed", "seq"), order)
    return speeds.groupBy("vin").agg(latest.alias("latest")).select("vin", "latest.*")


def speed_history_size(
    speeds: DataFrame, retention_ms: int = rules.SPEED_RETENTION_MS, bucket_ms: int = 120_000,
    block: int = 65_536,
) -> DataFrame:
    """Rows kept for a vehicle once each row is added, in order of arrival.

    The oldest row goes while it is more than ``retention_ms`` older than a
    newcomer, so what is kept goes back to the first row whose running latest
    time is within ``retention_ms`` of the newcomer's. That running time is
    worked out per ``block`` of arrival numbers, the counts per bucket of it, so
    a busy vehicle spreads over both. ``has_history`` tells whether anything was
    kept besides the row itself.
    """
    rows = speeds.select("vin", "sig_ts", "seq", F.floor(F.col("seq") / block).alias("_block"))
    blocks = rows.groupBy("vin", "_block").agg(F.max("sig_ts").alias("_latest"))
    earlier = Window.partitionBy("vin").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.select("vin", "_block", F.max("_latest").over(earlier).alias("_before")).withColumnsRenamed(
        {"vin": "_vin", "_block": "_b"})
    joined = rows.join(carried, F.col("vin").eqNullSafe(F.col("_vin")) & (F.col("_block") == F.col("_b")))
    own = Window.partitionBy("vin", "_block").orderBy("seq")
    running = joined.select(
        "vin", "sig_ts", "seq", F.greatest("_before", F.max("sig_ts").over(own)).alias("_now"))
    near = with_lookback(running, "_now", bucket_ms, retention_ms)
    group = Window.partitionBy("vin", "bucket")
    so_far = F.row_number().over(group.orderBy("seq"))
    gone = F.count(F.lit(1)).over(
        group.orderBy("_now").rangeBetween(Window.unboundedPreceding, -retention_ms - 1)
    )
    return (
        near.withColumn("so_far", so_far)
        .withColumn("gone", gone)
        .where("owner")
        .select("vin", "seq", "sig_ts", (F.col("so_far") - F.col("gone")).alias("history_size"))
        .withColumn("has_history", F.col("history_size") > 1)
    )


def encode_json(anomalies: DataFrame) -> DataFrame:
    """One JSON text per anomaly, fields in record order; values keep their JSON type."""

    def typed(text: str, kind: Column) -> Column:
        as_text = F.col(text).cast("variant")
        return (
            F.when(kind == "string", as_text)
            .when(kind == "decimal", F.col(text).try_cast("double").cast("variant"))
            .otherwise(F.coalesce(F.try_parse_json(text), as_text))
        )

    threshold_kind = F.when(F.col("threshold_value") == "true", "boolean").otherwise("decimal")
    message = F.struct(
        "vin",
        F.col("kafka_ts").alias("kafkaTimestamp"),
        F.col("sig_ts").alias("sigTimestamp"),
        F.col("anomaly_type").alias("anomalyType"),
        "severity",
        "description",
        F.col("sig_name").alias("sigName"),
        typed("current_value", F.col("value_type")).alias("currentValue"),
        typed("threshold_value", threshold_kind).alias("thresholdValue"),
        F.col("additional_info").alias("additionalInfo"),
    )
    return anomalies.select(
        "vin", "seq", "anomaly_type",
        F.to_json(message, {"ignoreNullFields": "false"}).alias("value"),
    )
