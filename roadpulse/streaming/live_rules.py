"""Rules as tables that a running stream reads anew for every micro-batch.

A rule table is a folder of numbered versions, each written whole; the newest complete one counts. Publishing a version
while a stream runs is safe: a batch reads one version from beginning to end. Rules are written by hand
and few, which ``read`` checks, so they may be compiled into the plan of the batch or sent to all tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

from roadpulse import rules
from roadpulse.session import newest_part
from roadpulse.sinks.writers import BatchWriter

MOST_RULES = 10_000
THRESHOLDS = "route string, position int, name string, signal_name string, threshold double, reason_code int"
SYSTEM = "sig_name string, anomaly_type string, severity string, description string, additional_info string"


def publish(spark: SparkSession, rows: Sequence[tuple], schema: str, path: str) -> None:
    """Write the rules as the next version of the table at ``path``."""
    newest = newest_part(spark, path, "version")
    version = int(newest.rpartition("=")[2]) + 1 if newest else 0
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/version={version}")


def read(spark: SparkSession, schema: str, path: str) -> list:
    """The rows of the newest version."""
    newest = newest_part(spark, path, "version")
    if newest is None:
        raise ValueError(f"no rules at {path}")
    found = spark.read.schema(schema).parquet(newest).limit(MOST_RULES + 1).collect()
    if len(found) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules at {path}: rules are meant to be few")
    return found


def threshold_rows(rules_by_route: Mapping[str, Sequence[rules.ThresholdRule]] = rules.RULES_BY_ROUTE) -> list[tuple]:
    """Crash rules as rows of THRESHOLDS."""
    return [(route, i, *rule) for route, listed in rules_by_route.items() for i, rule in enumerate(listed)]


def thresholds(spark: SparkSession, path: str) -> dict[str, list[rules.ThresholdRule]]:
    """Crash rules by route, in the order of their positions."""
    found: dict[str, list[rules.ThresholdRule]] = {}
    for row in sorted(read(spark, THRESHOLDS, path), key=lambda r: (r.route, r.position)):
        found.setdefault(row.route, []).append(
            rules.ThresholdRule(row.name, row.signal_name, row.threshold, row.reason_code))
    return found


def system_rules(spark: SparkSession, path: str) -> list[rules.SystemRule]:
    """System rules, those of one signal name by the last row of the name."""
    return list({r.sig_name: rules.SystemRule(*r) for r in sorted(read(spark, SYSTEM, path))}.values())


def judged_by(
    rules_of: Callable[[SparkSession, str], object], path: str, judge: Callable[[DataFrame, object], DataFrame],
    write: BatchWriter,
) -> BatchWriter:
    """A batch writer that judges every micro-batch by the rules as they are when it starts."""

    def judge_batch(batch: DataFrame, batch_id: int) -> None:
        write(judge(batch, rules_of(batch.sparkSession, path)), batch_id)

    return judge_batch
