"""Message decoding and value typing."""

import json

import pytest
from pyspark.sql import functions as F

from roadpulse.operators import anomalies
from roadpulse.sources import signals

INT_MAX = 2**31 - 1

# JSON value: (double, integer, boolean, string)
TYPED = {
    "true": (None, None, True, "true"),
    "false": (None, None, False, "false"),
    "null": (None, None, None, None),
    "0": (0.0, 0, False, "0"),
    "1": (1.0, 1, True, "1"),
    "-3": (-3.0, -3, True, "-3"),
    "4294967296": (4294967296.0, 0, False, "4294967296"),
    "2147483648": (2147483648.0, -2147483648, True, "2147483648"),
    "0.5": (0.5, 0, False, "0.5"),
    "1.9": (1.9, 1, True, "1.9"),
    "-1.9": (-1.9, -1, True, "-1.9"),
    "1.0": (1.0, 1, True, "1.0"),
    "25.50": (25.5, 25, True, "25.5"),
    "1e12": (1e12, INT_MAX, True, "1.0E12"),
    '"true"': (None, None, True, "true"),
    '"TRUE"': (None, None, True, "TRUE"),
    '"yes"': (None, None, False, "yes"),
    '"1"': (1.0, 1, False, "1"),
    '"25.5"': (25.5, None, False, "25.5"),
    '" 12 "': (12.0, None, False, " 12 "),
    '"+7"': (7.0, 7, False, "+7"),
    '"1e2"': (100.0, None, False, "1e2"),
    '"2147483648"': (2147483648.0, None, False, "2147483648"),
    '"nan"': (None, None, False, "nan"),
    '"inf"': (None, None, False, "inf"),
    '"Infinity"': (float("inf"), None, False, "Infinity"),
    '"abc"': (None, None, False, "abc"),
    '""': (None, None, False, ""),
}


def test_typing_table(spark):
    rows = spark.createDataFrame([(k,) for k in TYPED], "j string")
    typed = signals.coerce_values(rows.withColumn("value", F.parse_json("j")))
    got = {r.j: (r.as_double, r.as_integer, r.as_boolean, r.as_string) for r in typed.collect()}
    assert got == TYPED


def test_nan_text_reads_as_nan_and_missing_stays_missing(spark):
    rows = spark.createDataFrame([('"NaN"',), (None,)], "j string").withColumn("value", F.try_parse_json("j"))
    got = {r.j: (r.value_type, r.as_double) for r in signals.coerce_values(rows).collect()}
    assert got['"NaN"'][1] != got['"NaN"'][1]
    assert got[None] == (None, None)


FLAGS = ["true", '"TRUE"', "1", "-3", "1.9", "false", '"yes"', '"1"', "0", "0.5", "null"]


def test_flags(spark):
    rows = spark.createDataFrame(
        [("v", i, name, j) for i, (name, j) in enumerate([("AEB", j) for j in FLAGS] + [("aeb", "true")])],
        "vin string, seq bigint, sig_name string, j string",
    ).selectExpr("vin", "seq", "1L as kafka_ts", "2L as sig_ts", "sig_name", "parse_json(j) as value")
    fired = anomalies.system_signals(rows).collect()
    assert {r.seq for r in fired} == {0, 1, 2, 3, 4}
    assert {(r.anomaly_type, r.severity, r.threshold_value) for r in fired} == {("AEB_TRIGGERED", "HIGH", "true")}
    text = {r.seq: json.loads(r.value) for r in anomalies.encode_json(anomalies.system_signals(rows)).collect()}
    assert [text[i]["currentValue"] for i in range(5)] == [True, "TRUE", 1, -3, 1.9]
    assert list(text[0]) == ["vin", "kafkaTimestamp", "sigTimestamp", "anomalyType", "severity",
                             "description", "sigName", "currentValue", "thresholdValue", "additionalInfo"]


def message(**over):
    body = {"vin": "V", "kafkaTimestamp": 5, "sigTimestamp": 7, "sig": {"sigName": "speed", "value": 1.5}}
    body.update(over)
    return json.dumps({k: v for k, v in body.items() if v != "absent"})


# text: (error, kafka_ts, sig_ts); only the error matters where it is set.
MESSAGES = {
    message(): (None, 5, 7),
    message(sigTimestamp="12"): (None, 5, 12),
    message(sigTimestamp=1.7): (None, 5, 1),
    message(sigTimestamp="absent"): (None, 5, 0),
    message(sigTimestamp=None, kafkaTimestamp=""): (None, 0, 0),
    message(sigTimestamp=True): ("bad_timestamp", None, None),
    message(sigTimestamp="12x"): ("bad_timestamp", None, None),
    message(sigTimestamp=[1]): ("bad_timestamp", None, None),
    message(sig={}): (None, 5, 7),
    message(sig=None): ("no_sig", None, None),
    message(sig="absent"): ("no_sig", None, None),
    message(sig=3): ("malformed_json", None, None),
    message(vin="absent"): ("no_vin", None, None),
    " \n\t" + message(): (None, 5, 7),
    "": ("empty", None, None),
    "{bad": ("malformed_json", None, None),
    "[" + message() + "]": ("malformed_json", None, None),
    "12": ("malformed_json", None, None),
    "{'vin': 'V'}": ("malformed_json", None, None),
}


def parsed(spark, texts, **options):
    raw = spark.createDataFrame([(i, bytearray(t.encode())) for i, t in enumerate(texts)], "offset bigint, value binary")
    return signals.parse_messages(raw, **options).orderBy("seq").collect()


def test_messages(spark):
    rows = parsed(spark, MESSAGES)
    assert [r.seq for r in rows] == list(range(len(MESSAGES)))
    for text, want, row in zip(MESSAGES, MESSAGES.values(), rows):
        got = (row.error, row.kafka_ts, row.sig_ts) if want[0] is None else (row.error, None, None)
        assert got == want, text


def test_good_and_quarantined_messages_add_up(spark):
    raw = spark.createDataFrame(list(enumerate(MESSAGES)), "seq bigint, value string")
    good, bad = signals.decode_signals(raw), signals.quarantine(raw)
    assert good.count() + bad.count() == len(MESSAGES)
    assert "error" not in good.columns


@pytest.mark.parametrize("strict,errors", [(False, [None, None]), (True, ["unknown_field"] * 2)])
def test_unknown_fields(spark, strict, errors):
    texts = [message(extra=1), message(sig={"sigName": "speed", "value": 1, "unit": "m/s"})]
    assert [r.error for r in parsed(spark, texts, strict_fields=strict)] == errors


def test_missing_message_is_quarantined(spark):
    raw = spark.createDataFrame([(0, None)], "seq bigint, value string")
    assert [r.reason for r in signals.quarantine(raw).collect()] == ["empty"]


def test_filter_valid(spark):
    df = spark.sql("select 1 as a, named_struct('x', 1) as sig union all select 2, null")
    assert [r.a for r in signals.filter_valid(df).collect()] == [1]


def test_odd_vins(spark):
    df = spark.createDataFrame([("1HGCM82633A123456",), ("short",)], "vin string")
    assert [r.vin for r in signals.odd_vins(df).collect()] == ["short"]


def test_arrival_is_partition_and_offset(spark):
    text = '{"vin":"A","kafkaTimestamp":1,"sigTimestamp":2,"sig":{"sigName":"speed","value":1}}'
    rows = spark.createDataFrame([(text, 0, 7), (text, 1, 7), (text, 1, 8)], "value string, partition int, offset bigint")
    seqs = sorted(r.seq for r in signals.decode_signals(rows).collect())
    assert seqs == [7, (1 << 48) + 7, (1 << 48) + 8]
