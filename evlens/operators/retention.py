"""Cohort retention (F4), weighted headline (F5) and cohort maturity.

A user's cohort is the UTC date of their first event *in the window*; they are
retained on day N if they have any event on cohort + N.

Plan: distinct (user, UTC day) - a partial aggregate bounded by users x days -
then ``min(day) over (partition by user)`` on that reduced set, whose partitions
hold at most one row per day of the window however active the user is.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evlens.functions.cohort import restrict_users
from evlens.functions.timecols import day_to_date, utc_day
from evlens.schema import USER
from evlens.sources.scan import scan

OFFSETS = (1, 7, 30)


def user_days(window: DataFrame, group_cols: list[str] | None = None) -> DataFrame:
    """Distinct (group, user, UTC day number) of a scanned window, NULL users dropped."""
    g = list(group_cols or [])
    return window.where(F.col(USER).isNotNull()).select(*g, USER, utc_day().alias("day")).distinct()


def user_retention(window: DataFrame, offsets=OFFSETS, group_cols: list[str] | None = None) -> DataFrame:
    """One row per (group,) user: ``cohort_day`` and a boolean ``d{N}`` per offset.

    ``group_cols`` (e.g. a period label) computes independent cohorts per group.
    """
    return retention_flags(user_days(window, group_cols), offsets, group_cols)


def retention_flags(ud: DataFrame, offsets=OFFSETS, group_cols: list[str] | None = None) -> DataFrame:
    """``user_retention`` from distinct (group, user, day) rows."""
    g = list(group_cols or [])
    ud = ud.withColumn("cohort_day", F.min("day").over(Window.partitionBy(*g, USER)))
    off = F.col("day") - F.col("cohort_day")
    return (ud.groupBy(*g, USER, "cohort_day")
            .agg(*[F.max(off == n).alias(f"d{n}") for n in offsets]))


def cohort_table(per_user: DataFrame, group_cols: list[str] | None = None, offsets=OFFSETS) -> DataFrame:
    """Per cohort day: size, retained users and rates per offset."""
    g = list(group_cols or [])
    aggs = [F.count(F.lit(1)).alias("cohort_size")]
    aggs += [F.count_if(F.col(f"d{n}")).alias(f"d{n}_users") for n in offsets]
    out = per_user.groupBy(*g, day_to_date(F.col("cohort_day")).alias("cohort_date")).agg(*aggs)
    rates = [F.try_divide(F.col(f"d{n}_users"), F.col("cohort_size")).alias(f"d{n}_rate") for n in offsets]
    return out.select(*g, "cohort_date", "cohort_size", *[f"d{n}_users" for n in offsets], *rates)


def retention(events: DataFrame, start: str, end: str, cohort: list[dict] | None = None) -> DataFrame:
    """cohort_date, cohort_size, d1/d7/d30 users and rates, ordered by cohort date."""
    window = scan(events, start, end)
    per_user = restrict_users(user_retention(window), window, cohort)
    return cohort_table(per_user).orderBy("cohort_date")


def headline(cohorts: DataFrame, group_cols: list[str] | None = None, offsets=OFFSETS) -> DataFrame:
    """weighted rates sum(dN_users) / sum(cohort_size); 0 when there are no users."""
    g = list(group_cols or [])
    total = F.coalesce(F.sum("cohort_size"), F.lit(0)).cast("long")
    sums = {n: F.coalesce(F.sum(f"d{n}_users"), F.lit(0)).cast("long") for n in offsets}
    agg = cohorts.groupBy(*g).agg(total.alias("total_users"),
                                  *[sums[n].alias(f"d{n}_retained") for n in offsets])
    avgs = [F.when(F.col("total_users") > 0, F.col(f"d{n}_retained") / F.col("total_users"))
            .otherwise(F.lit(0.0)).alias(f"d{n}_avg") for n in offsets]
    return agg.select(*g, *avgs, *[f"d{n}_retained" for n in offsets], "total_users")


def retention_headline(events: DataFrame, start: str, end: str, cohort: list[dict] | None = None) -> DataFrame:
    window = scan(events, start, end)
    per_user = restrict_users(user_retention(window), window, cohort)
    return headline(cohort_table(per_user))


def maturity(cohorts: DataFrame, as_of) -> DataFrame:
    """whether D1 / D7 / D30 can be shown: the earliest cohort must be that old."""
    span = F.datediff(F.lit(as_of), F.min("cohort_date"))
    return (cohorts.agg(F.min("cohort_date").alias("earliest_cohort"), span.alias("days_span"))
            .select("earliest_cohort", "days_span",
                    *[(F.col("days_span") >= n).alias(f"d{n}_ready") for n in OFFSETS]))
