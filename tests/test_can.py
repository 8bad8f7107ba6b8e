"""CAN lines, bit fields, whole-file judgement, threshold crossings and verdicts."""

import random

import pytest
from pyspark.sql import functions as F

from roadpulse import rules
from roadpulse.functions.bits import CUT_PLAN, raw_value
from roadpulse.operators import can, verdict
from roadpulse.rules import ThresholdRule
from roadpulse.schemas import SIGNAL_DEF
from roadpulse.sources import can_logs
from roadpulse.sources.tables import read_signal_defs

DEFS = "message_id bigint, name string, start_bit int, size int, is_signed boolean, factor double, offset double"



def positioned(defs):
    """All of one message definition."""
    return defs.selectExpr("0 as position", "*")


LINES = {
    "(12) can0 1F4#ABCD": (None, 12, 500, "ABCD"),
    "  (-3)\tcan0  1f4#abcd extra fields ": (None, -3, 500, "abcd"),
    "12 can0 000000001F4#": (None, 12, 500, ""),
    "\x0b\f(7) can0 1f4#00ff\r": (None, 7, 500, "00ff"),
    "(12) can0": ("fields", None, None, None),
    "(12.5) can0 1F4#AB": ("timestamp", None, None, None),
    "(1x) can0 1F4#AB": ("timestamp", None, None, None),
    "(9223372036854775808) can0 1F4#AB": ("timestamp", None, None, None),
    "(12) can0 1F4##AB": ("frame", None, None, None),
    "(12) can0 1F4": ("frame", None, None, None),
    "(12) can0 1G#AB": ("can_id", None, None, None),
    "(12) can0 #AB": ("can_id", None, None, None),
    "(12) can0 1FFFFFFFF#AB": ("can_id", None, None, None),
    "(12) can0 FFFFFFFF#AB": (None, 12, 2**32 - 1, "AB"),
    "(12) can0 1F4#ABC": ("odd_hex", None, None, None),
    "(12) can0 1F4#ZZ": ("hex", None, None, None),
}


def frames(spark, files):
    """files: {name: [line, ...]}"""
    rows = [(f, i, line) for f, lines in files.items() for i, line in enumerate(lines)]
    return can_logs.parse_frames(spark.createDataFrame(rows, "file string, line_no bigint, line string"))


def test_lines(spark):
    texts = ["", "   "] + list(LINES)
    parsed = frames(spark, {"f": texts}).withColumn("name", can_logs.error_name(F.col("error")))
    got = {r.line: (r.name, r.ts, r.can_id, r.payload) for r in parsed.collect()}
    assert got == LINES


def bit_field(data: bytes, start: int, size: int, signed: bool) -> int:
    bits = "".join(f"{b:08b}" for b in data)[start:start + size][-64:]
    value = int(bits, 2)
    return value - (1 << len(bits)) if (signed or len(bits) == 64) and bits[0] == "1" else value


def test_bit_fields_against_text_cutting(spark):
    rng, rows = random.Random(2), []
    for i in range(1500):
        data = rng.randbytes(rng.choice([1, 2, 8, 8, 8, 12, 64]))
        size = rng.randint(1, min(len(data) * 8, rng.choice([1, 12, 64, 70])))
        start, signed = rng.randint(0, len(data) * 8 - size), rng.random() < 0.5
        rows.append((data.hex(), start, size, signed, str(bit_field(data, start, size, signed))))
    df = spark.createDataFrame(rows, "payload string, start_bit int, size int, is_signed boolean, want string")
    df = df.withColumn("plan", F.expr(CUT_PLAN))
    wrong = df.withColumn("got", F.expr(raw_value("payload", "plan")).cast("string")).where("not (got <=> want)")
    assert wrong.collect() == []


def decoded(spark, defs, lines, wanted=("a", "b")):
    table = positioned(spark.createDataFrame(defs, DEFS))
    return can.last_values(can.decode(frames(spark, {"f": lines}), table, list(wanted)))


def test_decode_examples(spark):
    got = decoded(
        spark,
        [(500, "a", 4, 12, False, 1.0, 0.0), (501, "b", 0, 8, True, 0.5, 1.0), (501, "unwanted", 0, 64, False, 1.0, 0.0)],
        ["(1) can0 1F4#ABCD", "(1) can0 1F5#FF", "(0) can0 1F5#11", "(1) can0 1F4#0001"],
    )
    assert {(r.ts, r.signal): r.value for r in got.collect()} == {(1, "a"): 1.0, (1, "b"): 0.5}


def test_first_definition_of_a_message_counts(spark):
    table = spark.createDataFrame(
        [(500, "a", 0, 8, False, 1.0, 0.0, 0), (500, "a", 8, 8, False, 1.0, 0.0, 1), (500, "b", 8, 8, False, 1.0, 0.0, 1)],
        DEFS + ", position int",
    )
    rows = can.decode(frames(spark, {"f": ["(1) can0 1F4#0102"]}), table, ["a", "b"]).collect()
    assert [(r.signal, r.value) for r in rows] == [("a", 1.0)]


CRASH_DEFS = [(500, "LongitudinalAcceleration", 0, 8, True, 0.1, 0.0),
              (500, "LateralAcceleration", 8, 8, True, 0.1, 0.0), (501, "crash", 0, 8, False, 1.0, 0.0),
              (502, "other", 0, 8, False, 1.0, 0.0)]

FILES = {
    "calm": ["(1) c 1F4#0000", "(2) c 1F4#0F08"],  # 1.5 and 0.8 are not over
    "first rule": ["(5) c 1F4#1000"],
    "earliest time": ["(9) c 1F4#1000", "(3) c 1F5#01"],
    "rule order": ["(1) c 1F4#1009"],
    "last line wins": ["(1) c 1F4#1000", "(1) c 1F4#0000"],
    "bad line": ["(5) c 1F4#1000", "(6) c 1F4#1"],
    "unknown id": ["(5) c 1F4#1000", "(6) c 7FF#10"],
    "short payload": ["(5) c 1F4#10"],
    "no wanted signal": ["(5) c 1F6#10"],
    "time zero": ["(0) c 1F4#1000"],
}
STRICT = {"calm": (None, None), "first rule": (5, 1), "earliest time": (3, 3), "rule order": (1, 1),
          "last line wins": (None, None)}
LENIENT = STRICT | {"bad line": (5, 1), "unknown id": (5, 1)}


@pytest.mark.parametrize("mode,want", [("strict", STRICT), ("lenient", LENIENT)])
def test_first_crossing(spark, mode, want):
    defs = positioned(spark.createDataFrame(CRASH_DEFS, DEFS))
    got = can.first_crossing(frames(spark, FILES), defs, rules.RULES_BY_ROUTE, mode).collect()
    assert {r.file: (r.crossings[0].ts, r.crossings[0].rule_index) for r in got} == want


def test_file_status(spark):
    defs = positioned(spark.createDataFrame(CRASH_DEFS, DEFS))
    wanted = can.wanted_signals(can.rule_sets(rules.RULES_BY_ROUTE))
    got = {r.file: (r.n_lines, r.n_bad, r.error) for r in can.file_status(frames(spark, FILES), defs, wanted).collect()}
    assert {f: e for f, (_, _, e) in got.items()} == dict.fromkeys(STRICT) | {
        "bad line": "odd_hex", "unknown id": "unknown_id", "short payload": "signal_range",
        "no wanted signal": "no_signal", "time zero": "no_signal"}
    assert got["bad line"] == (2, 1, "odd_hex")


def test_missing_signal_counts_as_zero(spark):
    defs = positioned(spark.createDataFrame(CRASH_DEFS, DEFS))
    below = {"r": [ThresholdRule("n", "LongitudinalAcceleration", 100.0, 2), ThresholdRule("c", "crash", -1.0, 3)]}
    got = can.first_crossing(frames(spark, {"f": ["(4) c 1F4#0000"]}), defs, below).collect()
    assert [(r.crossings[0].ts, r.crossings[0].rule_index) for r in got] == [(4, 2)]


def test_verdicts(spark):
    by_route = dict(rules.RULES_BY_ROUTE) | {rules.MEDIA_QUEUE: [ThresholdRule("Any", "crash", 0.5, 9)]}
    logs = frames(spark, {"x": ["(5) c 1F4#1000", "(7) c 1F5#01"], "y": ["(5) c 1F4#0000"], "z": ["(5) c 1F4#1"]})
    logs = logs.withColumn("vin", F.col("file")).withColumn("timestamp", F.lit(1).cast("bigint"))
    rows = spark.createDataFrame(
        [("x", "production", "1"), ("x", "media", "2"), ("y", "none", "3"), ("z", "none", "4"), ("w", "none", "5")],
        "vin string, usage_type string, trigger_id string",
    ).selectExpr("vin", "1L as timestamp", "'T' as car_type", "usage_type", "trigger_id", "'' as threshold_log")
    judged = verdict.crash_verdict(rows, logs, positioned(spark.createDataFrame(CRASH_DEFS, DEFS)), by_route)
    got = {r.trigger_id: (r.is_crash, r.reason_code, r.crash_ts, r.route, r.threshold_log) for r in judged.collect()}
    assert got == {
        "1": (1, 2, 5, rules.WRITE_DB_QUEUE, ";信号 LongitudinalAcceleration 超过阈值 1.500000,"),
        "2": (1, 9, 7, rules.WRITE_DB_QUEUE, ";信号 Any 超过阈值 0.500000,"),
        "3": (0, 0, None, rules.FUSION_QUEUE, ";"),
    }
    facts = {r.trigger_id: r.crash_reason for r in verdict.data_log_rows(judged).collect()}
    assert facts == {"1": rules.CRASH_REASONS[2], "2": "", "3": rules.CRASH_REASONS[0]}


def test_lines_of_files_keep_their_order(spark, tmp_path):
    """Files are read in splits; later lines of a file still have larger numbers."""
    for name in ("a", "b"):
        (tmp_path / name).write_text("".join(f"({i}) can0 1F4#{i % 256:02X}{'00' * 20}\n" for i in range(60_000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(1 << 20))
    try:
        lines = can_logs.read_lines(spark, str(tmp_path))
        assert lines.rdd.getNumPartitions() > 4
        parsed = can_logs.parse_frames(lines)
        rows = parsed.select("file", "line_no", "ts").toPandas().sort_values(["file", "line_no"])
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    for _, part in rows.groupby("file"):
        assert part.ts.tolist() == list(range(60_000))
        assert part.line_no.tolist() == list(range(1, 60_001))


def test_first_definition_of_an_id_wins_when_read_from_a_table(spark, tmp_path):
    rows = [(0, 500, "a", 0, 8, False, 1.0, 0.0), (1, 500, "a", 8, 8, False, 1.0, 0.0), (1, 500, "b", 0, 8, False, 1.0, 0.0)]
    spark.createDataFrame(rows, SIGNAL_DEF).write.parquet(str(tmp_path / "defs"))
    defs = read_signal_defs(spark, str(tmp_path / "defs"))
    decoded = can.decode(frames(spark, {"f": ["(1) can0 1F4#0A0B"]}), defs, ["a", "b"]).collect()
    assert [(r.signal, r.value) for r in decoded] == [("a", 10.0)]
    with pytest.raises(ValueError):
        can.message_table(defs.drop("position"), ["a"])


def test_numbers_count_blank_lines_and_start_anew_in_each_file(spark, tmp_path):
    (tmp_path / "a.log").write_text("\n(1) can0 1F4#00\n\n\n(2) can0 1F4#00\n")
    (tmp_path / "b.log").write_text("(3) can0 1F4#00")
    (tmp_path / "c.log").write_text("")
    rows = can_logs.parse_frames(can_logs.read_lines(spark, str(tmp_path))).collect()
    assert sorted((r.file[-5:], r.line_no, r.ts) for r in rows) == [("a.log", 2, 1), ("a.log", 5, 2), ("b.log", 1, 3)]


def encoded(n_bytes: int, order: str, start: int, size: int, value: int) -> bytes:
    """A payload of zeros with the signal's bits set one by one."""
    data = bytearray(n_bytes)
    for i in range(size):  # from the low bit up
        if order == "little":
            byte, bit = divmod(start + i, 8)
        else:  # the top bit is at ``start``; lower ones follow downwards and in the next bytes
            at = start // 8 * 8 + 7 - start % 8 + size - 1 - i
            byte, bit = at // 8, 7 - at % 8
        data[byte] |= (value >> i & 1) << bit
    return bytes(data)


@pytest.mark.parametrize("order", ["little", "big"])
def test_round_trip_in_both_byte_orders(spark, order):
    """Signals of up to 64 bits anywhere in payloads of up to 64 bytes, and one too long for its payload."""
    rng = random.Random(order)
    defs, lines, want = [], [], []
    for i in range(120):
        n = rng.choice([1, 2, 3, 8, 8, 12, 64])
        size = rng.randint(1, min(64, n * 8))
        first = rng.randint(0, n * 8 - size)  # of its lowest or topmost bit in payload order
        start = first if order == "little" else first // 8 * 8 + 7 - first % 8
        signed = rng.random() < 0.5 or size == 64
        value = rng.choice([0, (1 << size) - 1, rng.getrandbits(size)])
        defs.append((i, i, "s", start, size, signed, 1.0, 0.0, order))
        lines.append(f"({i + 1}) can0 {i:X}#{encoded(n, order, start, size, value).hex()}")
        want.append((i + 1, float(value - (1 << size) if signed and value >> (size - 1) else value)))
    table = spark.createDataFrame(
        defs, "position int, message_id bigint, name string, start_bit int, size int, is_signed boolean, factor double,"
        " offset double, byte_order string")
    got = can.decode(frames(spark, {"f": lines}), table, ["s"]).collect()
    assert sorted((r.ts, r.value) for r in got) == want
    short = frames(spark, {"f": [f"(1) can0 {i:X}#" for i in range(120)]})
    assert can.file_status(short, table, ["s"]).first().error == "signal_range"
