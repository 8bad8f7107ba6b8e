"""CAN logs: decode wanted signals, judge whole files, find the first threshold crossing.

Frames come from ``sources.can_logs.parse_frames``: file, line_no, ts, can_id,
payload, error. A file may be one of many or hold most of the rows; every step
per file is an aggregate that combines before the shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadpulse.functions.bits import ORDERED_PLAN, raw_value, turned
from roadpulse.functions.once import with_once
from roadpulse.rules import CROSSING_TEXT, ThresholdRule
from roadpulse.sources.can_logs import error_code, error_name


def message_table(defs: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """One row per known message id, with one cut plan ``d0, d1, ...`` per wanted signal
    (null where the message lacks it).

    ``defs`` has one row per signal. Its column ``position`` numbers the message
    definitions: of several for one id the first counts. ``byte_order`` is "sequential" (also if
    the column is missing), "little" or "big", see ``functions.bits``.
    """
    if "byte_order" not in defs.columns:
        defs = defs.withColumn("byte_order", F.lit("sequential"))
    if "position" not in defs.columns:
        raise ValueError("signal definitions need a position, by which the first of an id is known")
    names = [f"d{i}" for i in range(len(wanted))]
    messages = (
        defs.selectExpr("*", f"named_struct('cut', {ORDERED_PLAN}, 'factor', factor, 'offset', offset) as plan")
        .groupBy("message_id", "position")
        .agg(*[
            F.min_by("plan", F.when(F.col("name") == name, F.col("start_bit"))).alias(d)
            for d, name in zip(names, wanted)
        ])
    )
    return (
        messages.groupBy(F.col("message_id").alias("can_id"))
        .agg(F.min_by(F.struct(F.lit(True).alias("known"), *names), "position").alias("m"))
        .select("can_id", "m.*")
    )


def read_values(frames: DataFrame, defs: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """Add one column ``v0, v1, ...`` per wanted signal, ``useful``, and the errors of decoding.

    An unknown id or a payload too short for a wanted signal spoils the line.
    ``useful`` lines are sound, have a time other than 0 and at least one wanted signal.
    """
    known = frames.join(message_table(defs, wanted), "can_id", "left")
    plans = [f"d{i}" for i in range(len(wanted))]
    ends = ", ".join(f"{p}.cut.end_bit" for p in plans)
    judged = with_once(known, {
        "error": f"""case when error is not null then error
          when known is null then {error_code("unknown_id")}
          when greatest(0, 0, {ends}) > length(payload) * 4 then {error_code("signal_range")} end""",
        "_any": " or ".join(f"{p} is not null" for p in plans),
        "_turned": f"if({' or '.join(f'coalesce({p}.cut.turned, false)' for p in plans)}, {turned('payload')}, null)",
    }).withColumn("useful", F.expr("coalesce(error is null and ts <> 0 and _any, false)"))
    values = {
        v: f"if(useful, {raw_value(f'if({p}.cut.turned, _turned, payload)', p + '.cut')} * {p}.factor + {p}.offset, null)"
        for v, p in zip(_value_columns(wanted), plans)
    }
    keep = [c for c in frames.columns if c not in ("line", "payload", "can_id", "error")]
    return with_once(judged, values).select(*keep, "error", "useful", *values)


def decode(frames: DataFrame, defs: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """Long form: file, line_no, ts, signal, value for every wanted signal of the useful lines."""
    read = read_values(frames, defs, wanted).where("useful")
    pairs = F.array(*[
        F.struct(F.lit(name).alias("signal"), F.col(f"v{i}").alias("value"))
        for i, name in enumerate(wanted)
    ])
    keep = [c for c in read.columns if c not in ("error", "useful", *_value_columns(wanted))]
    return (
        read.select(*keep, F.explode(pairs).alias("p"))
        .select(*keep, "p.signal", "p.value")
        .where("value is not null")
    )


def _value_columns(wanted: Sequence[str]) -> list[str]:
    return [f"v{i}" for i in range(len(wanted))]


def last_values(decoded: DataFrame) -> DataFrame:
    """Per file, time and signal the value of the last line that sets it."""
    return decoded.groupBy("file", "ts", "signal").agg(F.max_by("value", "line_no").alias("value"))


def file_status(frames: DataFrame, defs: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """Whether each file is usable as a whole.

    One bad line, one unknown id, or no wanted signal at all fails the file;
    ``error`` is that of the first bad line.
    """
    judged = read_values(frames, defs, wanted)
    bad = F.col("error").isNotNull()
    return judged.groupBy("file").agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.count_if(bad).alias("n_bad"),
        F.count_if(F.col("useful")).alias("n_useful"),
        F.min_by("error", F.when(bad, F.col("line_no"))).alias("first_error"),
    ).select(
        "file", "n_lines", "n_bad",
        F.coalesce(error_name(F.col("first_error")), F.when(F.col("n_useful") == 0, F.lit("no_signal"))).alias("error"),
    ).withColumn("usable", F.col("error").isNull())


def wanted_signals(rule_sets: Sequence[Sequence[ThresholdRule]]) -> list[str]:
    """Distinct signal names of all rule sets, in order of appearance."""
    return list(dict.fromkeys(r.signal_name for rules in rule_sets for r in rules))


def first_crossing(
    frames: DataFrame,
    defs: DataFrame,
    rules_by_route: Mapping[str, Sequence[ThresholdRule]],
    mode: str = "strict",
    by: Sequence[str] = ("file",),
) -> DataFrame:
    """Per file and rule set, the earliest time a threshold is exceeded and by which rule.

    Result: the ``by`` columns and ``crossings``, an array with one
    struct(ts, rule_index) per rule set of ``rule_sets(rules_by_route)`` (with
    nulls where nothing crosses). ``mode="strict"`` leaves out files ``file_status``
    calls unusable; ``"lenient"`` only skips their bad lines.

    Two shuffles, both on pre-combined rows: the lines of a time are folded into
    one row with a column per wanted signal, times into one row per file. The
    last line of a time that sets a signal wins; a signal missing at a time
    counts as 0.0.
    """
    if mode not in ("strict", "lenient"):
        raise ValueError(f"mode must be 'strict' or 'lenient', not {mode!r}")
    sets = rule_sets(rules_by_route)
    wanted = wanted_signals(sets)
    read = read_values(frames, defs, wanted).withColumn("bad", F.col("error").isNotNull())
    last = [
        F.expr(f"max_by({v}, if({v} is null, null, line_no)) as {v}") for v in _value_columns(wanted)
    ]
    per_time = read.groupBy(*by, "ts").agg(
        F.max("bad").alias("bad"), F.max("useful").alias("useful"), *last
    )
    column = dict(zip(wanted, _value_columns(wanted)))

    def crossing(rules: Sequence[ThresholdRule]) -> str:
        # The first rule of the list that is exceeded at this time. Not-a-number exceeds nothing.
        branches = " ".join(
            f"when coalesce({column[r.signal_name]}, 0D) > {float(r.threshold)!r}D"
            f" and not isnan({column[r.signal_name]}) then {i + 1}"
            for i, r in enumerate(rules)
        )
        return f"case when not useful then null {branches} end"

    def first(index: str) -> Column:
        return F.expr(
            f"named_struct('ts', min(if({index} is null, null, ts)),"
            f" 'rule_index', min_by({index}, if({index} is null, null, ts)))"
        )

    indexes = {f"_c{i}": crossing(rules) for i, rules in enumerate(sets)}
    per_file = with_once(per_time, indexes).groupBy(*by).agg(
        F.max("bad").alias("bad"), F.max("useful").alias("useful"),
        F.array(*[first(c) for c in indexes]).alias("crossings"),
    )
    usable = F.col("useful") if mode == "lenient" else F.col("useful") & ~F.col("bad")
    return per_file.where(usable).select(*by, "crossings")


def rule_sets(rules_by_route: Mapping[str, Sequence[ThresholdRule]]) -> list[list[ThresholdRule]]:
    """The distinct rule lists, so that routes with equal rules are judged once."""
    sets: list[list[ThresholdRule]] = []
    for rules in rules_by_route.values():
        if list(rules) not in sets:
            sets.append(list(rules))
    return sets


def crossing_text(name: str, threshold: float) -> str:
    return CROSSING_TEXT % (name, threshold)
