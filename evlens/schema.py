"""Canonical event schema (GA4-style export) and column-name constants."""
from __future__ import annotations

from pyspark.sql import types as T

USER = "user_pseudo_id"
NAME = "event_name"
TS = "event_timestamp"          # int64 microseconds since the epoch, UTC
DATE = "event_date"             # export day, string yyyyMMdd (the shard key)

MICROS_PER_SECOND = 1_000_000
MICROS_PER_HOUR = 3_600 * MICROS_PER_SECOND
MICROS_PER_DAY = 24 * MICROS_PER_HOUR

PARAM_VALUE = T.StructType([
    T.StructField("string_value", T.StringType()),
    T.StructField("int_value", T.LongType()),
    T.StructField("float_value", T.DoubleType()),
    T.StructField("double_value", T.DoubleType()),
])
PARAM = T.StructType([
    T.StructField("key", T.StringType()),
    T.StructField("value", PARAM_VALUE),
])
PARAMS = T.ArrayType(PARAM)

EVENT_SCHEMA = T.StructType([
    T.StructField(DATE, T.StringType()),
    T.StructField(TS, T.LongType()),
    T.StructField(NAME, T.StringType()),
    T.StructField(USER, T.StringType()),
    T.StructField("platform", T.StringType()),
    T.StructField("geo", T.StructType([
        T.StructField("country", T.StringType()),
        T.StructField("region", T.StringType()),
        T.StructField("city", T.StringType()),
    ])),
    T.StructField("device", T.StructType([
        T.StructField("category", T.StringType()),
        T.StructField("operating_system", T.StringType()),
    ])),
    T.StructField("app_info", T.StructType([
        T.StructField("id", T.StringType()),
        T.StructField("version", T.StringType()),
    ])),
    T.StructField("traffic_source", T.StructType([
        T.StructField("source", T.StringType()),
        T.StructField("medium", T.StringType()),
        T.StructField("name", T.StringType()),
    ])),
    T.StructField("event_params", PARAMS),
    T.StructField("user_properties", PARAMS),
])
