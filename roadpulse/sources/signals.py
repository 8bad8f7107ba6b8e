"""Vehicle-signal messages: the Kafka source, JSON decoding and value typing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadpulse.functions import coerce
from roadpulse.functions.once import with_once

# The field names of a message.
MESSAGE_FIELDS = ["vin", "kafkaTimestamp", "sigTimestamp", "sig"]
SIG_FIELDS = ["sigName", "value"]
# Time stamps and the value may be of any JSON type; a message that does not fit lands in _bad.
MESSAGE_SCHEMA = (
    "vin string, kafkaTimestamp variant, sigTimestamp variant, "
    "sig struct<sigName string, value variant>, _bad string"
)
JSON_OPTIONS = {
    "columnNameOfCorruptRecord": "_bad", "allowSingleQuotes": "false",
    "allowNonNumericNumbers": "false",
}


def read_kafka(
    spark: SparkSession, servers: str, topic: str, starting: str = "latest",
    max_offsets: int | None = None, **options: str,
) -> DataFrame:
    """The topic as a stream of (key, value, partition, offset, ...).

    ``max_offsets`` bounds the rows of a micro-batch; set it where the backlog
    may be large. Needs Spark's Kafka package on the class path.
    """
    reader = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", starting)
    )
    if max_offsets:
        reader = reader.option("maxOffsetsPerTrigger", str(max_offsets))
    return reader.options(**options).load()


# Whole ms: missing, null and empty text are 0, decimals are cut, anything else is null. {n} is the
# bigint reading of {v}; the text is looked at only where that is null, or may stem from a boolean.
TIMESTAMP = """case
  when {n} is null then if(coalesce(btrim(try_variant_get({v}, '$', 'string')), '') = '', 0L, null)
  when {n} in (0, 1) and try_variant_get({v}, '$', 'string') in ('true', 'false') then null
  else {n} end"""


# Partition and offset share one bigint: 2^15 partitions of up to 2^48 messages.
OFFSET_BITS = 48


def parse_messages(df: DataFrame, strict_fields: bool = False) -> DataFrame:
    """Parse ``value`` (JSON text or bytes) and label each row with ``error`` (null if good).

    All other columns of ``df`` are kept; a Kafka frame's partition and offset
    become ``seq``, unique in the topic and in order within a partition, where
    all messages of a vehicle are until partitions are added (a frame without
    ``partition`` has one). One row in, one row out, no shuffle, so it runs on streams as well.
    With ``strict_fields`` a message with an unknown field is rejected.
    """
    if "seq" not in df.columns:
        number = f"shiftleft(cast(partition as bigint), {OFFSET_BITS}) + offset" if "partition" in df.columns else "offset"
        df = df.withColumn("seq", F.expr(number))
    keep = [c for c in df.columns if c != "value"]
    text = df.select(*keep, F.col("value").cast("string").alias("raw"))
    parsed = with_once(text, {"_m": F.from_json("raw", MESSAGE_SCHEMA, JSON_OPTIONS)})
    read = with_once(parsed, {
        "_kafka": "try_variant_get(_m.kafkaTimestamp, '$', 'bigint')",
        "_sig": "try_variant_get(_m.sigTimestamp, '$', 'bigint')",
    })
    fields = with_once(read, {
        "kafka_ts": TIMESTAMP.format(v="_m.kafkaTimestamp", n="_kafka"),
        "sig_ts": TIMESTAMP.format(v="_m.sigTimestamp", n="_sig"),
    })
    extra = "false"
    if strict_fields:
        extra = f"{_unknown_keys('raw', MESSAGE_FIELDS)} or {_unknown_keys(SIG_TEXT, SIG_FIELDS)}"
    return fields.selectExpr(
        *keep, "raw", "_m.vin", "kafka_ts", "sig_ts", "_m.sig.sigName as sig_name", "_m.sig.value",
        f"""case
          when coalesce(raw, '') = '' then 'empty'
          when _m is null or _m._bad is not null or not startswith(ltrim(' \\t\\n\\r', raw), '{{')
            then 'malformed_json'
          when {extra} then 'unknown_field'
          when _m.sig is null then 'no_sig'
          when _m.vin is null then 'no_vin'
          when kafka_ts is null or sig_ts is null then 'bad_timestamp' end as error""",
    )


SIG_TEXT = "get_json_object(raw, '$.sig')"


def _unknown_keys(text: str, known: list[str]) -> str:
    names = ", ".join(f"'{k}'" for k in known)
    return f"coalesce(size(array_except(json_object_keys({text}), array({names}))) > 0, false)"


def decode_signals(df: DataFrame, strict_fields: bool = False) -> DataFrame:
    """Good messages as (vin, kafka_ts, sig_ts, seq, sig_name, value)."""
    good = parse_messages(df, strict_fields).where("error is null")
    return good.drop("raw", "error")


def quarantine(df: DataFrame, strict_fields: bool = False) -> DataFrame:
    """Messages that cannot be used, with their text and the reason."""
    return parse_messages(df, strict_fields).where("error is not null").select(
        "seq", "raw", F.col("error").alias("reason")
    )


def filter_valid(df: DataFrame) -> DataFrame:
    """Drop rows without a signal: ``sig`` (nested form) or ``sig_name`` and ``value`` both null."""
    if "sig" in df.columns:
        return df.where("sig is not null")
    return df.where("sig_name is not null or value is not null")


def odd_vins(df: DataFrame) -> DataFrame:
    """Rows whose vehicle number has not the usual 17 characters; a quality check, they are kept."""
    return df.where("length(vin) <> 17")


def coerce_values(
    df: DataFrame,
    value: str = "value",
    targets: Sequence[str] = ("as_double", "as_integer", "as_boolean", "as_string"),
) -> DataFrame:
    """Add value_type and the wanted readings of a variant column."""
    schema = with_once(df, {"_schema": f"schema_of_variant({value})"})
    typed = with_once(schema, {"value_type": coerce.KIND.format(s="_schema")}).drop("_schema")
    return with_once(
        typed, {name: coerce.READINGS[name].format(v=value, k="value_type") for name in targets}
    )
