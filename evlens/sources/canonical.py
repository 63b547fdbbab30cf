"""Canonical event view.

Two inputs are supported:

* an export already in the canonical shape, laid out as Parquet partitioned by
  ``event_date`` (``read_events``); the explicit schema keeps ``event_date`` a
  string so ``BETWEEN`` on it prunes partitions;
* the flat tables of the test warehouse (``events`` + ``customer`` / ``nation`` /
  ``region``), reshaped by ``canonical_events``.

Mapping of the flat tables (fixture convention):
  user_pseudo_id  = user_id as string           event_name = event_type
  event_timestamp = micros of ts (UTC wall time) event_date = yyyyMMdd of ts
  event_params    = k (int), engagement_time_msec = round(value*1000),
                    ga_session_id = event_date as int, screen_name = event_type
  user_properties = segment = c_mktsegment
  geo.country / geo.region = n_name / r_name    platform = user_id % 3
  device.category = user_id % 2                 app_info.version = '2.' || k div 20
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evlens.functions.periods import check_day, parse_day
from evlens.functions.timecols import idiv, ntz_to_micros
from evlens.schema import DATE, EVENT_SCHEMA, NAME, TS, USER

# --- fixed values of the fixture mapping --------------------------------------
PLATFORMS = ("ANDROID", "IOS", "WEB")        # indexed by user_id % 3
DEVICE_CATEGORIES = ("mobile", "desktop")    # indexed by user_id % 2
# ------------------------------------------------------------------------------


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Canonical events stored as Parquet partitioned by ``event_date``."""
    return spark.read.schema(EVENT_SCHEMA).parquet(path)


def _null_str() -> Column:
    return F.lit(None).cast("string")


def _param(key: str, string_value: Column | None = None, int_value: Column | None = None) -> Column:
    return F.struct(
        F.lit(key).alias("key"),
        F.struct(
            (string_value if string_value is not None else _null_str()).cast("string").alias("string_value"),
            (int_value if int_value is not None else F.lit(None)).cast("long").alias("int_value"),
            F.lit(None).cast("double").alias("float_value"),
            F.lit(None).cast("double").alias("double_value"),
        ).alias("value"),
    )


def _pick(options: tuple[str, ...], idx: Column) -> Column:
    out = None
    for i, v in enumerate(options):
        out = (F.when(idx == i, F.lit(v)) if out is None else out.when(idx == i, F.lit(v)))
    return out


def user_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer x nation x region: one row per user with segment, nation and region.

    One row per key, in a way the optimizer can see: a query that reads no user attribute
    then needs no join at all. How it is joined otherwise is left to the planner.
    """
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_nationkey", "c_mktsegment")
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_name", "n_regionkey")
    region = spark.read.parquet(f"{sf_dir}/region.parquet").select("r_regionkey", "r_name")
    return (customer
            .join(nation, customer.c_nationkey == nation.n_nationkey, "left")
            .join(region, nation.n_regionkey == region.r_regionkey, "left")
            .select("c_custkey", "c_mktsegment", "n_name", "r_name")
            .dropDuplicates(["c_custkey"]))


def raw_events(spark: SparkSession, sf_dir: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """The flat events table, with an optional ``ts`` range pushed to the Parquet scan."""
    ev = spark.read.parquet(f"{sf_dir}/events.parquet")
    return bound_ts(ev, start, end)


def bound_ts(ev: DataFrame, start: str | None, end: str | None) -> DataFrame:
    if start is not None:
        ev = ev.where(F.col("ts") >= F.lit(parse_day(check_day(start))).cast("timestamp_ntz"))
    if end is not None:
        nxt = F.date_add(F.lit(parse_day(check_day(end))), 1)
        ev = ev.where(F.col("ts") < nxt.cast("timestamp_ntz"))
    return ev


def core_columns() -> list[Column]:
    """Shard day, micros, name and user of a flat event row (no dimension lookups)."""
    shard = F.date_format(F.to_date("ts"), "yyyyMMdd")
    return [shard.alias(DATE), ntz_to_micros(F.col("ts")).alias(TS),
            F.col("event_type").alias(NAME), F.col("user_id").cast("string").alias(USER)]


def canonicalize(ev: DataFrame, users: DataFrame) -> DataFrame:
    """Reshape flat events (batch or streaming) plus the user dimension into the
    canonical schema. A left join: when a query reads no user attribute the
    optimizer drops it altogether."""
    joined = ev.join(users, ev.user_id == users.c_custkey, "left")
    shard = F.date_format(F.to_date("ts"), "yyyyMMdd")
    k = F.get_json_object("props", "$.k").cast("int")
    return joined.select(
        *core_columns(),
        _pick(PLATFORMS, F.col("user_id") % 3).alias("platform"),
        F.struct(F.col("n_name").alias("country"), F.col("r_name").alias("region"),
                 _null_str().alias("city")).alias("geo"),
        F.struct(_pick(DEVICE_CATEGORIES, F.col("user_id") % 2).alias("category"),
                 _null_str().alias("operating_system")).alias("device"),
        F.struct(_null_str().alias("id"),
                 F.concat(F.lit("2."), idiv(k, 20).cast("string")).alias("version")).alias("app_info"),
        F.struct(_null_str().alias("source"), _null_str().alias("medium"),
                 _null_str().alias("name")).alias("traffic_source"),
        F.array(
            _param("k", int_value=k),
            _param("engagement_time_msec", int_value=F.round(F.col("value") * 1000).cast("long")),
            _param("ga_session_id", int_value=shard.cast("long")),
            _param("screen_name", string_value=F.col("event_type")),
        ).alias("event_params"),
        F.array(_param("segment", string_value=F.col("c_mktsegment"))).alias("user_properties"),
    )


def canonical_events(spark: SparkSession, sf_dir: str, start: str | None = None,
                     end: str | None = None) -> DataFrame:
    """Canonical view of the flat test tables.

    ``start`` / ``end`` (yyyyMMdd, inclusive) add a ``ts`` range on the raw scan so
    the bound reaches Parquet as a pushed filter; callers still apply
    ``scan(start, end)`` on ``event_date``.
    """
    return canonicalize(raw_events(spark, sf_dir, start, end), user_dimension(spark, sf_dir))
