"""Crash verdicts: join triggers to their CAN files, judge, route, and shape fact rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadpulse import rules
from roadpulse.functions.literals import literal_map
from roadpulse.operators.can import crossing_text, first_crossing, rule_sets
from roadpulse.operators.triggers import route_by_usage


def crash_verdict(
    triggers: DataFrame,
    frames: DataFrame,
    defs: DataFrame,
    rules_by_route: Mapping[str, Sequence[rules.ThresholdRule]] = rules.RULES_BY_ROUTE,
    mode: str = "strict",
    keep_unjudged: bool = False,
) -> DataFrame:
    """Triggers with their verdict; those without a usable CAN file are left out, or with ``keep_unjudged``
    stay as they are, with null for the route and the rest of the verdict.

    ``frames`` carries vin and timestamp of the trigger its log belongs to; there
    is one log per vehicle and time.
    ``is_crash`` is the position of the first rule exceeded, 0 if none;
    ``route`` becomes the write queue for crashes and the fusion queue for the rest.
    """
    crossings = first_crossing(frames, defs, rules_by_route, mode, by=("vin", "timestamp"))
    judged = route_by_usage(triggers).join(crossings, ["vin", "timestamp"], "left" if keep_unjudged else "inner")
    sets = rule_sets(rules_by_route)
    which = F.lit(None).cast("int")
    for route, wanted in rules_by_route.items():
        which = F.when(F.col("route") == route, sets.index(list(wanted))).otherwise(which)
    hit = F.get("crossings", which)
    position = F.coalesce(hit.rule_index, F.lit(0))
    judged = judged.withColumn("_set", which).withColumn("_pos", position)
    info = _by_rule(sets, lambda r: F.lit(crossing_text(r.name, r.threshold)), F.lit(""))
    reason = _by_rule(sets, lambda r: F.lit(r.reason_code), F.lit(0))
    known = F.col("crossings").isNotNull()
    return judged.withColumns({
        "threshold_log": F.when(known, F.concat("threshold_log", F.lit(";"), info)).otherwise(F.col("threshold_log")),
        "reason_code": F.when(known, reason),
        "is_crash": F.when(known, F.col("_pos")),
        "crash_ts": hit.ts,
        "route": F.when(known, F.when(F.col("_pos") != 0, rules.WRITE_DB_QUEUE).otherwise(rules.FUSION_QUEUE)),
    }).drop("_set", "_pos", "crossings")


def attach_logs(triggers: DataFrame, manifests: DataFrame, lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lines with the vin and timestamp of their trigger, triggers with ``file`` and ``error``).

    ``manifests`` are rows of ``select_can_file`` with a whole-number timestamp, ``lines`` rows of ``read_lines``.
    A trigger without a manifest, without a CAN file in it, or with a file of no lines has an
    ``error``; so its verdict is missing for a reason that can be counted.
    """
    listed = manifests.select("vin", "timestamp", F.col("file_url").alias("file"), F.col("error").alias("_listed"))
    listed = listed.groupBy("vin", "timestamp").agg(F.min_by(F.struct("file", "_listed"), F.struct(
        F.col("_listed").isNotNull(), "file")).alias("m")).select("vin", "timestamp", "m.*", F.lit(True).alias("_known"))
    there = lines.select("file").distinct().withColumn("_there", F.lit(True))
    asked = triggers.join(listed, ["vin", "timestamp"], "left").join(there, "file", "left").withColumn("error", F.when(
        F.col("_known").isNull(), "no_manifest").when(F.col("_listed").isNotNull(), F.col("_listed")).when(
            F.col("_there").isNull(), "missing_file")).select(*triggers.columns, "file", "error")
    owners = asked.where("error is null").select("vin", "timestamp", "file").distinct()
    return lines.drop("vin", "timestamp").join(owners, "file"), asked


def unjudged(triggers: DataFrame, status: DataFrame) -> DataFrame:
    """Triggers that get no verdict: vin, timestamp, file, reason.

    ``triggers`` are the second frame of ``attach_logs``, ``status`` comes from ``file_status``.
    """
    judged = triggers.join(status.select("file", F.col("error").alias("_file_error")), "file", "left")
    reason = F.coalesce("error", "_file_error")
    return judged.select("vin", "timestamp", "file", reason.alias("reason")).where("reason is not null")


def _by_rule(sets: Sequence[Sequence[rules.ThresholdRule]], of, default: Column) -> Column:
    branches = [
        F.when((F.col("_set") == s) & (F.col("_pos") == i + 1), of(rule))
        for s, wanted in enumerate(sets)
        for i, rule in enumerate(wanted)
    ]
    return F.coalesce(*branches, default)


def data_log_rows(
    verdicts: DataFrame,
    reasons: Mapping[int, str] = rules.CRASH_REASONS,
    code: str = "reason_code",
) -> DataFrame:
    """Fact rows; the trigger's time as UTC date and time, and a code outside the reason table as ""."""
    reason = F.try_element_at(literal_map(reasons), F.col(code))
    return verdicts.select(
        "vin",
        F.expr("timestamp_ntz'1970-01-01' + make_dt_interval(0, 0, 0, timestamp / 1000)").alias("trigger_timestamp"),
        "car_type",
        F.col("usage_type").alias("use_type"),
        "trigger_id",
        "is_crash",
        F.coalesce(reason, F.lit("")).alias("crash_reason"),
        F.col("threshold_log").alias("criterion_judgment"),
    )
