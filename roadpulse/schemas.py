"""Explicit schemas of the records the library reads and writes."""

from __future__ import annotations

from pyspark.sql import types as T

# One page of the trigger feed.
TRIGGER_PAGE = T.StructType([
    T.StructField("code", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("message", T.StringType()),
    T.StructField("total", T.IntegerType()),
    T.StructField("page", T.IntegerType()),
    T.StructField("page_size", T.IntegerType()),
    T.StructField("data", T.ArrayType(T.StructType([
        T.StructField("vin", T.StringType()),
        T.StructField("timestamp", T.StringType()),
        T.StructField("car_type", T.StringType()),
        T.StructField("tag", T.ArrayType(T.StringType())),
        T.StructField("trigger_info", T.ArrayType(T.StructType([
            T.StructField("trigger_id", T.IntegerType()),
            T.StructField("trigger_name", T.StringType()),
        ]))),
    ]))),
])

# Answer of the file service for one trigger.
FILE_MANIFEST = T.StructType([
    T.StructField("code", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("message", T.StringType()),
    T.StructField("data", T.StructType([
        T.StructField("vin", T.StringType()),
        T.StructField("timestamp", T.StringType()),
        T.StructField("car_type", T.StringType()),
        T.StructField("tag", T.ArrayType(T.StringType())),
        T.StructField("file_info", T.ArrayType(T.StructType([
            T.StructField("file_type", T.StringType()),
            T.StructField("file_url", T.StringType()),
        ]))),
    ])),
])

# A trigger as it travels between routes.
TRIGGER = T.StructType([
    T.StructField("vin", T.StringType()),
    T.StructField("timestamp", T.LongType()),
    T.StructField("car_type", T.StringType()),
    T.StructField("usage_type", T.StringType()),
    T.StructField("trigger_id", T.StringType()),
    T.StructField("log_id", T.LongType()),
    T.StructField("threshold_log", T.StringType()),
    T.StructField("is_crash", T.IntegerType()),
])

# How to cut one signal out of a CAN payload.
SIGNAL_DEF = T.StructType([
    # Number of the message definition in its source; of several for one id the first counts.
    T.StructField("position", T.IntegerType()),
    T.StructField("message_id", T.LongType()),
    T.StructField("name", T.StringType()),
    T.StructField("start_bit", T.IntegerType()),
    T.StructField("size", T.IntegerType()),
    T.StructField("is_signed", T.BooleanType()),
    T.StructField("factor", T.DoubleType()),
    T.StructField("offset", T.DoubleType()),
])

# Usage dimension, one row per assignment of a vehicle.
CAR_USER_INFO = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("updated_at", T.TimestampType()),
    T.StructField("create_at", T.TimestampType()),
    T.StructField("vin", T.StringType()),
    T.StructField("car_type", T.StringType()),
    T.StructField("use_type", T.StringType()),
    T.StructField("nower_name", T.StringType()),
    T.StructField("priority", T.IntegerType()),
    T.StructField("project_name", T.StringType()),
])

# Columns every anomaly frame has, in this order.
ANOMALY_COLUMNS = [
    "vin", "kafka_ts", "sig_ts", "seq", "anomaly_type", "severity", "description", "sig_name",
    "current_value", "threshold_value", "value_type", "additional_info",
    "current_speed", "previous_speed", "previous_seq",
]

# Columns of the SQL anomaly table (the key columns vin, seq, anomaly_type replace a surrogate id).
ANOMALY_TABLE_COLUMNS = [
    "vin", "seq", "kafka_timestamp", "sig_timestamp", "anomaly_type", "severity", "description",
    "sig_name", "current_value", "threshold_value", "additional_info", "created_at", "event_date",
]
