"""CAN log lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from roadpulse.functions.once import with_once

# What can be wrong with a line, in the order the checks are made; a row's error is a position here.
LINE_ERRORS = ["fields", "timestamp", "frame", "can_id", "odd_hex", "hex", "unknown_id", "signal_range"]


def error_code(name: str) -> int:
    return LINE_ERRORS.index(name)


def error_name(code: Column) -> Column:
    return F.get(F.array(*[F.lit(e) for e in LINE_ERRORS]), code)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of all log files below ``path`` as (file, line_no, line), numbered from 1 within each file.

    Large files stay splittable and no file has to fit in one row: a scan task reads the lines of a block in order, so
    a line's number is the count of lines in the blocks before its own, plus its place in the block. The counts, a row per
    block, come from a first scan that takes no text out of the tasks; lines themselves are not moved unless there are too
    many blocks for Spark to send to all tasks.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_row"), F.col("value").alias("line"))
    earlier = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = lines.groupBy(F.col("file").alias("_file"), F.col("_start").alias("_block")).agg(
        F.count(F.lit(1)).alias("_n"), F.min("_row").alias("_first"),
    ).withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    met = lines.join(blocks, (F.col("file") == F.col("_file")) & (F.col("_start") == F.col("_block")))
    return met.select("file", (F.col("_before") + F.col("_row") - F.col("_first") + 1).alias("line_no"), "line")


def parse_frames(lines: DataFrame, line: str = "line") -> DataFrame:
    """Split ``(ts) iface ID#HEX`` lines into ts, can_id and payload.

    ``error`` is null for a sound line, else a position in LINE_ERRORS. Blank
    lines are left out, other columns are kept; one row in, one row out.
    """
    spaces = r"' \t\n\r\u000b\u000c'"
    fields = with_once(
        lines.where(f"btrim({line}, {spaces}) <> ''"),
        {"_f": rf"split(btrim({line}, {spaces}), '\\s+')"},
    )
    cut = with_once(fields, {
        "_n": "size(_f)",
        # The field holds no spaces, so the cast takes a sign and digits only.
        "_ts": "try_cast(btrim(get(_f, 0), '()') as bigint)",
        "_id": "substring_index(get(_f, 2), '#', 1)",
        "_data": "substring(get(_f, 2), length(substring_index(get(_f, 2), '#', 1)) + 2)",
        "_marks": "length(get(_f, 2)) - length(replace(get(_f, 2), '#', ''))",
    })
    checked = with_once(cut, {"error": f"""case
      when _n < 3 then {error_code("fields")}
      when _ts is null then {error_code("timestamp")}
      when _marks <> 1 then {error_code("frame")}
      when _id = '' or unhex(_id) is null or length(ltrim('0', _id)) > 8 then {error_code("can_id")}
      when length(_data) % 2 <> 0 then {error_code("odd_hex")}
      when unhex(_data) is null then {error_code("hex")} end"""})
    keep = [c for c in lines.columns if c not in ("error", "ts", "can_id", "payload")]
    return checked.selectExpr(
        *keep, "error",
        "if(error is null, _ts, null) as ts",
        "if(error is null, cast(conv(_id, 16, 10) as bigint), null) as can_id",
        "if(error is null, _data, null) as payload",
    )
