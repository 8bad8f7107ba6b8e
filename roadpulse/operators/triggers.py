"""Triggers: ingest, usage type, routing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadpulse import rules
from roadpulse.functions.coerce import parse_int
from roadpulse.operators.asof import HOUR_MS, lookup_before
from roadpulse.sources.trigger_feed import records


def first_allowed(ids: Column, allowed: Sequence[int] = tuple(rules.ALLOWED_TRIGGER_IDS)) -> Column:
    """First id, in record order, that is on the allow list, as text; null if none is."""
    listed = sorted(set(allowed))
    return F.get(F.filter(ids, lambda x: x.isin(listed)), 0).cast("string")


def label_records(pages: DataFrame, allowed: Sequence[int] = tuple(rules.ALLOWED_TRIGGER_IDS)) -> DataFrame:
    """Records with parsed time, matched trigger id, and the reason a record is dropped."""
    return records(pages).select(
        "vin",
        F.col("timestamp").alias("raw_timestamp"),
        parse_int(F.col("timestamp"), "bigint").alias("timestamp"),
        "car_type",
        first_allowed(F.col("trigger_info.trigger_id"), allowed).alias("trigger_id"),
    ).withColumn(
        "reason",
        F.when(F.col("timestamp").isNull(), "bad_timestamp").when(
            F.col("trigger_id").isNull(), "no_allowed_trigger"
        ),
    )


def dropped_records(pages: DataFrame, allowed: Sequence[int] = tuple(rules.ALLOWED_TRIGGER_IDS)) -> DataFrame:
    return label_records(pages, allowed).where("reason is not null")


def usage_lookup(
    triggers: DataFrame,
    usage: DataFrame,
    pick: str = "first",
    ts: str = "timestamp",
    create_ms: str = "create_ms",
    bucket_ms: int = HOUR_MS,
) -> DataFrame:
    """Add ``usage_type``: what the vehicle was used for at ``ts`` (epoch ms), else "none".

    ``pick="first"`` takes, of the assignments made up to then, the one with the
    lowest id; ``pick="latest"`` the one made last.
    """
    if pick == "first":
        value, best = F.struct("id", "use_type"), "min"
    elif pick == "latest":
        value, best = F.struct(create_ms, "id", "use_type"), "max"
    else:
        raise ValueError(f"pick must be 'first' or 'latest', not {pick!r}")
    found = lookup_before(
        triggers, usage, "vin", ts, create_ms, value, best, "_usage", bucket_ms
    )
    return found.withColumn(
        "usage_type", F.coalesce(F.col("_usage.use_type"), F.lit(rules.NO_USAGE))
    ).drop("_usage")


def log_id(*key: str) -> Column:
    """Number of the process log of a trigger: 60 bits of a hash, the same whenever the trigger is read again."""
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in key])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint").alias("log_id")


def ingest(
    pages: DataFrame,
    usage: DataFrame,
    pick: str = "first",
    allowed: Sequence[int] = tuple(rules.ALLOWED_TRIGGER_IDS),
) -> DataFrame:
    """Trigger rows ready for the default route. Records are dropped before the lookup, not after."""
    kept = label_records(pages, allowed).where("reason is null").drop("reason", "raw_timestamp")
    return usage_lookup(kept, usage, pick).select(
        "vin", "timestamp", "car_type", "usage_type", "trigger_id",
        log_id("vin", "timestamp", "trigger_id"), F.lit("").alias("threshold_log"), F.lit(0).alias("is_crash"),
    )


def route_of(usage_type: Column) -> Column:
    """Route of a usage type; unknown and missing types go with production."""
    named = [F.when(usage_type == use, F.lit(route)) for use, route in rules.USAGE_ROUTES.items()]
    return F.coalesce(*named, F.lit(rules.PRODUCTION_QUEUE))


def route_by_usage(triggers: DataFrame) -> DataFrame:
    return triggers.withColumn("route", route_of(F.col("usage_type")))
