"""Vehicle-shaped views derived row by row from the driver's ``events`` table.

Each view has a Spark form here and, for the oracle, the same definition as SQL
in ``plans/oracle.py``. 3600 real ms count as 1 ms of signal time, so the 1 s,
2 s and 30 s limits meet real neighbours. All views are narrow projections (or
a fixed number of rows per event), so they cost one scan and no shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadpulse.functions.literals import literal_table
from roadpulse.functions.once import with_once
from roadpulse.session import shared_dir

EVENTS_SCHEMA = (
    "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
)
# Read from the fields of the local time, so that the session's time zone plays no part.
EPOCH_MS = (
    "(datediff(ts, DATE'1970-01-01') * 86400000L + hour(ts) * 3600000 + minute(ts) * 60000"
    " + cast(floor(extract(SECOND FROM ts) * 1000) as bigint))"
)
VIN = "concat('VIN', lpad(cast(user_id as string), 14, '0'))"
SIG_TS = f"{EPOCH_MS} div 3600"
# Shown text of a value: two decimals in both engines.
VALUE_TEXT = "cast(cast(value as decimal(10,2)) as string)"
K = "cast(regexp_extract(props, '([0-9]+)', 1) as int)"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.schema(EVENTS_SCHEMA).parquet(f"{sf_dir}/events.parquet")


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Written as a pattern, because a stream takes a single file only from one.
    return spark.readStream.schema(EVENTS_SCHEMA).parquet(f"{sf_dir}/events.parque[t]")


# Events in one file of a batch. Spark counts a file as 4 MiB at least, so even a scan task of 128 MiB has few of them.
EVENTS_A_FILE = 50_000


def event_batches(
    spark: SparkSession, sf_dir: str, batches: int = 3, closing: bool = False, file_rows: int = EVENTS_A_FILE,
) -> DataFrame:
    """The events as a stream of ``batches`` micro-batches in order of arrival, from files below the shared folder.

    ``closing`` adds a batch of one event of user -1, ten days after all others, which moves the watermark past them.
    A batch has as many files as its rows need at ``file_rows`` each, written and read by as many tasks; each batch has
    the same number of them, which is how the stream tells batches apart.
    """
    source = shared_dir(spark, "event-batches")
    rows = events(spark, sf_dir)
    low, high = rows.agg(F.min("event_id"), F.max("event_id")).first()
    parts = []
    for i in range(batches if low is not None else 0):
        # Arrival numbers differ from event ids in their last five bits only.
        first, last = (low + (high + 1 - low) * (i + j) // batches >> 5 << 5 for j in (0, 1))
        parts.append((F.col("event_id") >= (first if i else low)) & (
            F.col("event_id") < (last if i < batches - 1 else high + 1)))
    most = max(rows.agg(*[F.count_if(p) for p in parts]).first()) if parts else 0
    files = max(1, -(-most // file_rows))
    for i, part in enumerate(parts, start=1):
        _in_files(rows.where(part), files).write.mode("append").parquet(source)
        missing = files * i - len(spark.read.schema(EVENTS_SCHEMA).parquet(source).inputFiles())
        if missing > 0:
            # A batch of few rows leaves files out; rows without an id, which nobody reads, take their place.
            spark.range(0, missing, 1, missing).selectExpr(
                *[f"cast(null as {kind}) as {name}" for name, kind in (f.split() for f in EVENTS_SCHEMA.split(", "))],
            ).write.mode("append").parquet(source)
    if closing and low is not None:
        last = rows.agg(F.max("ts").alias("ts")).selectExpr(
            f"{high + 64}L as event_id", "ts + interval 10 days as ts", "-1L as user_id", "'click' as event_type",
            "61D as value", "'' as props")
        last.coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(EVENTS_SCHEMA).option("maxFilesPerTrigger", files)
    return stream.parquet(source).where("event_id is not null")


def _in_files(rows: DataFrame, files: int) -> DataFrame:
    """Rows dealt evenly over ``files`` tasks; for a single one they need no shuffle."""
    return rows.repartition(files) if files > 1 else rows.coalesce(1)


def derive_signals(ev: DataFrame) -> DataFrame:
    """Every event as one signal row; clicks are speeds, the other types are flags of mixed type."""
    return ev.selectExpr(
        f"{VIN} as vin",
        f"{SIG_TS} + event_id % 1000 as kafka_ts",
        f"{SIG_TS} as sig_ts",
        "event_id ^ 31 as seq",
        """case event_type when 'click' then 'speed' when 'error' then 'AEB'
             when 'purchase' then 'NOA_EXIT' when 'signup' then 'ACC_EXIT'
             when 'view' then 'LKA_EXIT' end as sig_name""",
        """case when event_type = 'click' then cast(value as variant)
             when event_id % 4 = 0 then cast(value > 60 as variant)
             when event_id % 4 = 1 then cast(if(value > 60, 'TRUE', 'yes') as variant)
             when event_id % 4 = 2 then cast(if(value > 60, 1, 0) as variant)
             else cast(0.5D as variant) end as value""",
    )


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive_signals(events(spark, sf_dir))


def derive_speed_signals(ev: DataFrame) -> DataFrame:
    """Every event as a speed row, so that neighbours are frequent."""
    return ev.selectExpr(
        f"{VIN} as vin", f"{SIG_TS} + event_id % 1000 as kafka_ts", f"{SIG_TS} as sig_ts",
        "event_id ^ 31 as seq", "'speed' as sig_name", "cast(value as variant) as value",
    )


def derive_late_signals(ev: DataFrame) -> DataFrame:
    """Every event as a speed row; two in 97 are 60 s and 200 s late."""
    return ev.selectExpr(
        f"{VIN} as vin", f"{SIG_TS} + event_id % 1000 as kafka_ts",
        f"{SIG_TS} - case event_id % 97 when 3 then 60000 when 50 then 200000 else 0 end as sig_ts",
        "event_id ^ 31 as seq", "'speed' as sig_name", "cast(value as variant) as value",
    )


def derive_state_signals(ev: DataFrame) -> DataFrame:
    """Every event as a speed row up to 24 s late; some speeds are NaN."""
    return ev.selectExpr(
        f"{VIN} as vin", f"{SIG_TS} + event_id % 1000 as kafka_ts",
        f"{SIG_TS} - event_id % 7 * 4000 as sig_ts", "event_id ^ 31 as seq", "'speed' as sig_name",
        "if(event_id % 13 = 5, cast('NaN' as variant), cast(value as variant)) as value",
    )


def state_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive_state_signals(events(spark, sf_dir))


def speed_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive_speed_signals(events(spark, sf_dir))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a JSON message (value, seq); some are broken on purpose."""
    rows = events(spark, sf_dir).selectExpr(
        "event_id", "event_type", "event_id ^ 31 as seq", "cast(event_id % 17 as int) as m",
        f"{VIN} as vin", f"{SIG_TS} as sig_ts", f"{VALUE_TEXT} as text",
    )
    return with_once(rows, {"value": (
        """case when m = 0 then '' when m = 1 then concat('{bad', event_id) else concat('{',
          if(m = 3, '', concat('"vin":"', vin, '"', if(m = 4, ',', ''))),
          case when m = 5 then concat(',"kafkaTimestamp":"', sig_ts, '",') when m = 6 then ',"kafkaTimestamp":null,'
            when m = 7 then concat(',"kafkaTimestamp":', sig_ts, ',')
            when m > 7 then concat(',"kafkaTimestamp":', sig_ts + event_id % 1000, ',') else '' end,
          case when m = 2 then concat(',"sigTimestamp":', sig_ts) when m in (3, 6) then ''
            when m = 4 then concat('"sigTimestamp":"', sig_ts, 'x",')
            when m = 5 then concat('"sigTimestamp":', sig_ts, '.7,') else concat('"sigTimestamp":', sig_ts, ',') end,
          if(m = 2, '', concat('"sig":{"sigName":"', event_type, '","value":',
            case when m in (3, 4) then '1' when m = 5 then 'true' when m = 6 then 'null'
              when m = 7 then concat('"', text, '"') else text end, '}')),
          '}') end"""
    )}).select("seq", "value")


def mixed_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of every JSON kind (seq, value), for the typing rules."""
    return events(spark, sf_dir).selectExpr(
        "event_id as seq",
        f"""parse_json(case event_id % 16
          when 0 then 'true' when 1 then 'false'
          when 2 then '"TRUE"' when 3 then '"yes"' when 4 then '"1"'
          when 5 then concat('"', {VALUE_TEXT}, '"')
          when 6 then '"NaN"' when 7 then '"nan"' when 8 then '"12abc"' when 9 then '" 12 "'
          when 10 then '0.5' when 11 then '-1.9' when 12 then 'null'
          when 13 then cast(event_id as string)
          when 14 then if(event_id % 32 = 14, cast((event_id % 1000) * 4294967296 as string),
            concat(event_id % 1000 + 1, '0000000000000000000003'))
          else {VALUE_TEXT} end) as value""",
    )


def trigger_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive_trigger_pages(events(spark, sf_dir))


def derive_trigger_pages(ev: DataFrame) -> DataFrame:
    """Every event that is no signup as a page of the trigger feed with two records.

    The first record is sound; the second repeats the vehicle with a time stamp
    that is sound or broken in one of several ways.
    """
    info = (
        f"array(named_struct('trigger_id', {K} + 100, 'trigger_name', 'a'),"
        f" named_struct('trigger_id', {K}, 'trigger_name', 'b'),"
        f" named_struct('trigger_id', {K} % 7, 'trigger_name', 'c'))"
    )
    second = f"""case event_id % 6 when 0 then '12a' when 1 then ' 12' when 2 then '1.5'
      when 3 then '9223372036854775808' when 4 then concat('+', {EPOCH_MS})
      else cast({EPOCH_MS} - 1000 as string) end"""
    record = (
        "named_struct('vin', {vin}, 'timestamp', {ts}, 'car_type', concat('T', user_id % 5),"
        " 'tag', array(event_type), 'trigger_info', {info})"
    )
    return ev.where("event_type <> 'signup'").selectExpr(
        "'0' as code", "'ok' as status", "'' as message", "2 as total",
        "cast(event_id % 1000000 as int) as page", "2 as page_size",
        "array("
        + record.format(vin=VIN, ts=f"cast({EPOCH_MS} as string)", info=info)
        + ", "
        + record.format(vin=VIN, ts=second, info=f"if(event_id % 3 = 0, array(), {info})")
        + ") as data",
    )


USE_TYPE = """case event_id % 5 when 0 then 'production' when 1 then 'test_drive'
  when 2 then 'media' when 3 then 'internal' else 'perception' end"""


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signups as usage assignments. Ids fall with time for odd users, so key order is not time order."""
    return events(spark, sf_dir).where("event_type = 'signup'").selectExpr(
        "if(user_id % 2 = 0, event_id, 1000000000000 - event_id) as id",
        f"{VIN} as vin", f"{EPOCH_MS} as create_ms", f"{USE_TYPE} as use_type",
    )


def triggers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive_triggers(events(spark, sf_dir))


def derive_triggers(ev: DataFrame) -> DataFrame:
    """Events that are no signup as triggers, before the usage lookup."""
    return ev.where("event_type <> 'signup'").selectExpr(
        "event_id", f"{VIN} as vin", f"{EPOCH_MS} as timestamp", f"{K} as k",
        "concat('T', user_id % 5) as car_type",
    )


def manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The file list of each event; some have no CAN file, some have two."""
    entry = "named_struct('file_type', {kind}, 'file_url', concat('{prefix}/', event_id))"
    video, can_a, can_b = (
        entry.format(kind="'video'", prefix="v"), entry.format(kind="'can'", prefix="a"),
        entry.format(kind="'can'", prefix="b"),
    )
    return events(spark, sf_dir).selectExpr(
        "event_id",
        f"""named_struct('vin', {VIN}, 'timestamp', cast({EPOCH_MS} as string),
          'car_type', concat('T', user_id % 5), 'tag', array(event_type),
          'file_info', case event_id % 4 when 0 then array({video}, {can_a}, {can_b})
            when 1 then array({can_b}, {video}) when 2 then array({video}) else array() end) as data""",
    )


# Signal layout of the CAN fixture: (position, message_id, name, start_bit, size, is_signed, factor, offset).
# The definitions at 3 and 4 come second for their ids and count for nothing.
SIGNAL_DEFS = [
    (0, 500, "LongitudinalAcceleration", 0, 16, True, 0.0001, 0.0),
    (0, 500, "LateralAcceleration", 20, 12, True, 0.001, -0.25),
    (0, 500, "Unused", 32, 8, False, 1.0, 0.0),
    (1, 501, "crash", 39, 1, False, 1.0, 0.0),
    (2, 502, "Unused", 0, 8, False, 1.0, 0.0),
    (3, 500, "crash", 0, 1, False, 1.0, 0.0),
    (4, 501, "LateralAcceleration", 0, 8, False, 1.0, 0.0),
]
# Two multiplicative hashes give the payload halves; both engines compute them as bigint.
HALF_A = "((event_id * 4 + i) % 1000003 * 2654435761) % 4294967296"
HALF_B = "((event_id * 4 + i) % 1000003 * 40503 * 1009 + 12345) % 4294967296"


def can_rows(ev: DataFrame) -> DataFrame:
    """Four numbered CAN lines per trigger event, with the integers behind them."""
    return ev.where("event_type <> 'signup'").selectExpr(
        "event_id", f"{VIN} as vin", f"{EPOCH_MS} as timestamp", f"{SIG_TS} as sig_ts",
        "explode(sequence(0L, 3L)) as i",
    ).selectExpr("*", f"{HALF_A} as half_a", f"{HALF_B} as half_b")


def can_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive_can_lines(events(spark, sf_dir))


def derive_can_lines(ev: DataFrame) -> DataFrame:
    """CAN log lines (file, line_no, line, vin, timestamp); one short file per trigger event.

    The third line is broken in one of ten ways for part of the files; the last
    line repeats the time of the first, so its signals win there.
    """
    payload = "concat(lpad(hex(half_a), 8, '0'), lpad(hex(half_b), 8, '0'))"
    rows = can_rows(ev).selectExpr(
        "concat('clip/', event_id) as file", "vin", "timestamp", "event_id", "sig_ts", "i as line_no",
        f"{payload} as payload", "if(i = 2, event_id % 23, -1) as kind", "event_id % 23 = 10 as foreign",
    )
    return with_once(rows, {"line": (
        """concat(
          case when kind = 8 then '(0' when kind = 5 then concat('(', sig_ts, '.25')
            when kind between 0 and 9 or foreign then concat('(', sig_ts)
            else concat('  (', sig_ts + if(line_no = 3, 0, line_no)) end,
          ')  can0 ',
          case kind when 1 then '' when 2 then '1F4##' when 3 then '1G#' when 6 then '7FF#'
            else if(foreign, '1F6#', if(line_no = 1, '1f5#', '1F4#')) end,
          case kind when 1 then '' when 4 then 'ABC' when 7 then 'AABB' when 9 then 'ZZ' else payload end,
          if(kind = 1, '', ' rx'))"""
    )}).selectExpr("file", "vin", "timestamp", "line_no", "if(kind = 0, '', line) as line")


def signal_defs(spark: SparkSession) -> DataFrame:
    return literal_table(
        spark, SIGNAL_DEFS,
        "position int, message_id bigint, name string, start_bit int, size int, is_signed boolean,"
        " factor double, offset double",
    )


def step_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive_step_events(events(spark, sf_dir))


def derive_step_events(ev: DataFrame) -> DataFrame:
    """Processing steps: six events in a row make one log; even steps push, odd steps pop.

    Every eleventh log lacks its first step, so its other steps have no log to update.
    """
    return ev.selectExpr(
        "event_id div 6 as log_id",
        "event_id % 6 as step",
        """case when event_id % 6 = 5 and event_id % 4 = 0 then 'DB Write Success'
             else concat(event_type, '_triggers') end as name""",
        "(event_id % 6 = 0 and (event_id div 6) % 11 <> 0) as is_insert",
        "concat(event_type, '_triggers') as queue_type",
        "concat('T', user_id % 5) as vehicle_type",
        "if(value > 60, 'failed', 'ok') as status",
        "cast(round(value * 20) as bigint) as duration_ms",
        "cast(event_id % 11 * 5 as bigint) as wait_ms",
        f"{EPOCH_MS} as ts", "event_id as seq", "cast(value as bigint) as size",
    )


def derive_queue_moves(ev: DataFrame) -> DataFrame:
    """Every event as a move of a queue: two of three are pushes, the third takes one off the queue of its type."""
    return ev.selectExpr(
        "concat(event_type, '_triggers') as route", "if(event_id % 3 = 2, -1L, 1L) as delta", f"{EPOCH_MS} as ts",
    )


LINES_A_FILE = 10_000


def write_logs(spark: SparkSession, sf_dir: str, path: str) -> None:
    """The CAN lines of ``LINES_A_FILE / 4`` events in a row as one text file, in order; more data makes more files."""
    lines = can_lines(spark, sf_dir).selectExpr(
        "cast(substring(file, 6) as bigint) as event_id", "line_no", "line",
        f"cast(substring(file, 6) as bigint) div {LINES_A_FILE // 4} as log")
    lines.repartition("log").sortWithinPartitions("log", "event_id", "line_no").select("log", "line").write.partitionBy(
        "log").text(path)


# Signals of the CAN payloads in both byte orders; the fourth crosses from byte to byte at both its ends.
ORDERED_DEFS = [
    (0, 500, "low_word", 8, 16, True, 1.0, 0.0, "little"),
    (0, 500, "high_word", 7, 16, False, 0.5, -3.0, "big"),
    (0, 500, "whole", 0, 64, True, 1.0, 0.0, "little"),
    (0, 500, "across", 13, 21, False, 1.0, 0.0, "little"),
    (0, 500, "down", 19, 14, True, 1.0, 0.0, "big"),
    (1, 501, "flag", 39, 1, False, 1.0, 0.0, "little"),
]


def ordered_defs(spark: SparkSession) -> DataFrame:
    return literal_table(
        spark, ORDERED_DEFS,
        "position int, message_id bigint, name string, start_bit int, size int, is_signed boolean,"
        " factor double, offset double, byte_order string",
    )
