"""Event-level aggregations and projections."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evlens.functions.cohort import cohort_users, restrict_users
from evlens.functions.literals import literal_frame
from evlens.functions.params import param_double, param_int, param_string
from evlens.functions.timecols import shard_to_date, utc_day
from evlens.schema import NAME, TS, USER
from evlens.sources.scan import recent_scan, sample_day, scan


def event_param_sample(events: DataFrame, event_name: str, param_key: str, start: str, end: str,
                       limit: int = 100) -> DataFrame:
    """User, time and the three typed values of one param for one event.

    Ordered by (time, user) before the limit so the sample is deterministic; the
    ordered limit runs as a per-partition top-k followed by a merge of k rows each.
    """
    return (scan(events, start, end)
            .where(F.col(NAME) == F.lit(event_name))
            .select(USER, F.col(TS).alias("event_time"),
                    param_string(param_key).alias("param_string"),
                    param_int(param_key).alias("param_int"),
                    param_double(param_key).alias("param_double"))
            .orderBy("event_time", USER)
            .limit(limit))


def _ranked(df: DataFrame, metric: str, limit: int | None) -> DataFrame:
    ordered = df.orderBy(F.col(metric).desc(), F.col(NAME).asc_nulls_last())
    return ordered if limit is None else ordered.limit(limit)


def event_user_counts(window: DataFrame) -> DataFrame:
    """(user, event) -> rows. The pre-aggregate behind E1: it shrinks the data
    before any cohort join and spreads a hot event over many (user, event) keys."""
    return window.groupBy(USER, NAME).agg(F.count(F.lit(1)).alias("n"))


def top_events(events: DataFrame, start: str, end: str, limit: int | None = 50,
               cohort: list[dict] | None = None) -> DataFrame:
    """Per event name, row count and distinct users, by count desc (name breaks ties).

    Without a cohort, rows with a NULL user count in ``event_count`` but not in
    ``unique_users``. With a cohort, only cohort users' events count.
    """
    window = scan(events, start, end)
    per_user = event_user_counts(window)
    if cohort:
        per_user = per_user.join(cohort_users(window, cohort), USER, "left_semi")
    agg = per_user.groupBy(NAME).agg(F.sum("n").alias("event_count"), F.count(USER).alias("unique_users"))
    return _ranked(agg, "event_count", limit)


def daily_activity(events: DataFrame, start: str, end: str, cohort: list[dict] | None = None,
                   approx: bool = False, rsd: float = 0.01) -> DataFrame:
    """Distinct users per shard day (``day`` as a date), ordered by day.

    ``approx`` counts with HyperLogLog++ (``approx_count_distinct``, relative standard
    deviation ``rsd``): a few KB of state per day and no shuffle of (day, user) pairs.
    """
    window = scan(events, start, end)
    if approx and not cohort:
        return (window.groupBy(shard_to_date(F.col("event_date")).alias("day"))
                .agg(F.approx_count_distinct(USER, rsd).alias("dau")).orderBy("day"))
    pairs = window.select("event_date", USER).distinct()
    pairs = restrict_users(pairs, window, cohort)
    return (pairs.groupBy(shard_to_date(F.col("event_date")).alias("day"))
            .agg(F.count(USER).alias("dau"))
            .orderBy("day"))


def active_users(events: DataFrame, start: str, end: str, cohort: list[dict] | None = None,
                 approx: bool = False, rsd: float = 0.01) -> DataFrame:
    """Distinct users in the window (one row); ``approx`` uses HyperLogLog++."""
    window = scan(events, start, end)
    if approx and not cohort:
        return window.agg(F.approx_count_distinct(USER, rsd).alias("active_users"))
    users = window.where(F.col(USER).isNotNull()).select(USER).distinct()
    return restrict_users(users, window, cohort).agg(F.count(F.lit(1)).alias("active_users"))


def total_events(events: DataFrame, start: str, end: str, cohort: list[dict] | None = None) -> DataFrame:
    """Number of event rows in the window (one row)."""
    window = scan(events, start, end)
    if not cohort:
        return window.agg(F.count(F.lit(1)).alias("total_events"))
    per_user = restrict_users(window.groupBy(USER).agg(F.count(F.lit(1)).alias("n")), window, cohort)
    return per_user.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("total_events"))


def recent_users(events: DataFrame, start: str, end: str, limit: int = 20) -> DataFrame:
    """E5: most active non-NULL users with first / last seen (micros) and active UTC days."""
    agg = (scan(events, start, end).where(F.col(USER).isNotNull())
           .groupBy(USER)
           .agg(F.count(F.lit(1)).alias("event_count"),
                F.min(TS).alias("first_seen"), F.max(TS).alias("last_seen"),
                F.count_distinct(utc_day()).alias("active_days")))
    return agg.orderBy(F.col("event_count").desc(), F.col(USER).asc()).limit(limit)


def freshness(events: DataFrame, as_of, days_back: int = 3) -> DataFrame:
    """Latest event time (micros) and number of shards with data in the last days."""
    return (recent_scan(events, as_of, days_back)
            .agg(F.max(TS).alias("latest_event"),
                 F.count_distinct("event_date").alias("days_with_data")))


# --- fixed values: raw columns offered by field discovery -----------------------
DISCOVERY_COLUMNS = (
    ("geo.country", "Country"),
    ("geo.region", "Region"),
    ("geo.city", "City"),
    ("platform", "Platform"),
    ("device.category", "Device category"),
    ("device.operating_system", "OS"),
    ("app_info.version", "App version"),
    ("traffic_source.source", "Traffic source"),
    ("traffic_source.medium", "Traffic medium"),
)
# ---------------------------------------------------------------------------------


def field_discovery(events: DataFrame, day: str, sample: int | None = None) -> DataFrame:
    """Filterable fields - distinct user-property keys and event-param keys of one
    shard, plus the fixed raw columns. Columns: field_type, field, label.

    ``sample`` optionally looks at a hash sample of that many rows (the reference reads
    50,000 arbitrary rows); the default reads the whole shard.
    """
    shard = sample_day(events, day, sample).select("user_properties", "event_params")
    up = (shard.select(F.explode(F.col("user_properties")["key"]).alias("field"))
          .distinct().select(F.lit("user_property").alias("field_type"), "field"))
    ep = (shard.select(F.explode(F.col("event_params")["key"]).alias("field"))
          .distinct().select(F.lit("event_param").alias("field_type"), "field"))
    found = up.unionByName(ep).where(F.col("field").isNotNull()).withColumn("label", F.col("field"))
    cols = literal_frame(events.sparkSession, [("field_type", "string"), ("field", "string"), ("label", "string")],
                         [("column", f, lbl) for f, lbl in DISCOVERY_COLUMNS])
    return cols.unionByName(found)
