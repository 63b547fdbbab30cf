"""Row counts and latest times per day of a written table, from Parquet footers (E4, E11 without reading rows)."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evlens.schema import DATE, EVENT_SCHEMA, TS
from evlens.sources.scan import scan

# Sources that Spark reads by its older reader, which cannot take an aggregate; Parquet is usually one.
OLDER_READERS = "spark.sql.sources.useV1SourceList"


def day_facts(spark: SparkSession, path: str, start: str, end: str) -> DataFrame:
    """``event_date``, ``events``, ``latest_event`` (micros) of every day in [start, end] that has rows.

    The table is day-partitioned (``sink.write_events``). With
    ``spark.sql.parquet.aggregatePushdown`` on (``session.build_session`` sets it) count and maximum come from
    the footers of the days' files; without it the same rows come from a scan of one column.
    """
    before = spark.conf.get(OLDER_READERS)
    spark.conf.set(OLDER_READERS, ",".join(s for s in before.split(",") if s.strip() != "parquet"))
    try:        # the reader is chosen here, when the path is looked up
        events = spark.read.schema(EVENT_SCHEMA).parquet(path)
    finally:
        spark.conf.set(OLDER_READERS, before)
    return scan(events, start, end).groupBy(DATE).agg(F.count(F.lit(1)).alias("events"), F.max(TS).alias("latest_event"))


def total_events(facts: DataFrame) -> DataFrame:
    """E4 from ``day_facts`` (one row)."""
    return facts.agg(F.coalesce(F.sum("events"), F.lit(0)).cast("long").alias("total_events"))


def freshness(facts: DataFrame) -> DataFrame:
    """E11 from the ``day_facts`` of the last days (one row)."""
    return facts.agg(F.max("latest_event").alias("latest_event"), F.count(F.lit(1)).alias("days_with_data"))
