"""Property breakdowns (E7, F6a, F6b) and two-cohort comparison.

The reference runs the chart once per top value. Here it is one pass over the window and
one chain of aggregates: rows are reduced to (user, value), where a value counts for a
user who has one event row on which the base cohort and ``field = value`` hold together,
next to the facts of the chart (step times, active days), which do not depend on the
value and are put together per user by a window over these reduced rows. Every value is
counted, as its users are one partial aggregate anyway, and the top ones are kept. A
user matching several values appears in several series, exactly as in N separate runs.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evlens.functions.cohort import cohort_predicate, field_column, resolve_field_type
from evlens.functions.literals import literal_frame
from evlens.operators import funnel as FN
from evlens.operators import retention as R
from evlens.functions.timecols import utc_day
from evlens.schema import NAME, TS, USER
from evlens.sources.scan import scan


def _value_rows(window: DataFrame, value: Column, base_cohort: list[dict] | None) -> DataFrame:
    pred = cohort_predicate(base_cohort)
    rows = window if pred is None else window.where(pred)
    return rows.select(USER, value.alias("value"))


def value_users(window: DataFrame, field: str, field_type: str,
                base_cohort: list[dict] | None = None) -> DataFrame:
    """Distinct (value, user) over rows of the base cohort with a non-empty value.

    A partial aggregate; both the top-value ranking and the membership table are
    derived from it, so one scan and one shuffle serve both.
    """
    rows = _value_rows(window, field_column(field, field_type), base_cohort)
    return (rows.where(F.col("value").isNotNull() & (F.col("value") != "") & F.col(USER).isNotNull())
            .select("value", USER).distinct())


def top_values(pairs: DataFrame, top_n: int) -> DataFrame:
    return (pairs.groupBy("value").agg(F.count(F.lit(1)).alias("users"))
            .orderBy(F.col("users").desc(), F.col("value").asc())
            .limit(top_n))


def breakdown_values(events: DataFrame, field: str, field_type: str | None, start: str, end: str,
                     top_n: int = 5, base_cohort: list[dict] | None = None) -> DataFrame:
    """Top-N values of a field by distinct users among rows of the base cohort.

    Columns ``value, users``; ordered by users desc then value. NULL and empty
    values are dropped before grouping.
    """
    ft = resolve_field_type(field, field_type)
    return top_values(value_users(scan(events, start, end), field, ft, base_cohort), top_n)


def _value(field: str, field_type: str, base_cohort: list[dict] | None) -> Column:
    """The value a row counts for: NULL outside the base cohort and for empty values."""
    value = field_column(field, field_type).cast("string")
    pred = cohort_predicate(base_cohort)
    counts = (value != "") if pred is None else pred & (value != "")
    return F.when(counts, value)


def _value_rows_of(window: DataFrame, field: str, field_type: str | None, base_cohort: list[dict] | None) -> DataFrame:
    """Rows of known users with the ``value`` they count for."""
    value = _value(field, resolve_field_type(field, field_type), base_cohort)
    return window.where(F.col(USER).isNotNull()).withColumn("value", value)


def _wanted_values(counts: DataFrame, top_n: int | None, values: list | None) -> DataFrame:
    """The ``top_n`` values by users, or the given ones in any case (0 where they do not occur)."""
    if values is None:
        return counts.orderBy(F.col("users").desc(), F.col("value").asc()).limit(top_n)
    wanted = literal_frame(counts.sparkSession, [("value", "string")], [(str(v),) for v in values])
    # The given values bound both sides of this join.
    return wanted.join(F.broadcast(counts.where(F.col("value").isin([str(v) for v in values]))), "value", "left")


def funnel_breakdown(events: DataFrame, steps: list[str], start: str, end: str, field: str,
                     field_type: str | None = None, window_days: int = 7,
                     base_cohort: list[dict] | None = None, top_n: int = 5,
                     strict: bool = False) -> DataFrame:
    """The funnel once per top value, in one pass.

    Columns: series_label, series_users, step_index, event, users,
    drop_off_from_prev_pct, conversion_from_start_pct.
    """
    steps = FN.check_steps(steps)
    names = [f"s{i}" for i in range(1, len(steps) + 1)]
    rows = _value_rows_of(scan(events, start, end), field, field_type, base_cohort)
    firsts = (rows.where(F.col("value").isNotNull() | F.col(NAME).isin(list(dict.fromkeys(steps))))
              .groupBy(USER, "value").agg(*[F.min(F.when(F.col(NAME) == s, F.col(TS))).alias(n) for s, n in zip(steps, names)]))
    per_value = (firsts.select("value", *[F.min(n).over(Window.partitionBy(USER)).alias(n) for n in names])
                 .where(F.col("value").isNotNull()))
    reached = [F.count_if(F.coalesce(FN.step_reached(i, window_days, strict), F.lit(False))).alias(f"step_{i}_users")
               for i in range(1, len(steps) + 1)]
    counts = per_value.groupBy("value").agg(F.count(F.lit(1)).alias("users"), *reached)
    full = _wanted_values(counts, top_n, None).withColumnsRenamed({"value": "series_label", "users": "series_users"})
    return FN.shape_steps(full, steps, ["series_label", "series_users"])


def _retention_series(window: DataFrame, field: str, field_type: str | None, base_cohort: list[dict] | None,
                      top_n: int | None = None, values: list | None = None) -> DataFrame:
    """Weighted rates per value: of a value's users, the share active N days after their first day in the window."""
    user = Window.partitionBy(USER)
    days = (_value_rows_of(window, field, field_type, base_cohort).select(USER, "value", utc_day().alias("day")).distinct()
            .withColumn("cohort_day", F.min("day").over(user)))
    back = [F.max(F.col("day") == F.col("cohort_day") + n).over(user).alias(f"d{n}") for n in R.OFFSETS]
    per_value = (days.select(USER, "value", *back).where(F.col("value").isNotNull())
                 .groupBy(USER, "value").agg(*[F.max(f"d{n}").alias(f"d{n}") for n in R.OFFSETS]))
    counts = per_value.groupBy("value").agg(F.count(F.lit(1)).alias("users"), *[F.count_if(f"d{n}").alias(f"d{n}") for n in R.OFFSETS])
    users = F.coalesce(F.col("users"), F.lit(0)).cast("long")
    return _wanted_values(counts, top_n, values).select(
        F.col("value").alias("series_label"), users.alias("series_users"),
        *[F.coalesce(F.try_divide(F.col(f"d{n}"), F.col("users")), F.lit(0.0)).alias(f"d{n}_rate") for n in R.OFFSETS],
        users.alias("total_users"))


def retention_breakdown(events: DataFrame, start: str, end: str, field: str,
                        field_type: str | None = None, base_cohort: list[dict] | None = None,
                        top_n: int = 5) -> DataFrame:
    """Weighted D1/D7/D30 rates and cohorted users per top value, one pass."""
    return _retention_series(scan(events, start, end), field, field_type, base_cohort, top_n)


def compare_cohorts(events: DataFrame, start: str, end: str, dimension: str, value_a: str,
                    value_b: str | None = None) -> DataFrame:
    """retention headline for ``dimension = a`` and ``= b``; an empty or repeated second value is none."""
    wanted = [value_a, value_b] if value_b and value_b != value_a else [value_a]
    return _retention_series(scan(events, start, end), dimension, None, None, values=wanted)
