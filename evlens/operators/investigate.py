"""Investigation of a fired insight: WHERE (segment concentration) and WHEN (timeline).

E8 affected users, E9 axis shares, F18 concentration, E10 daily timeline,
F19 baseline and change day. The base cohort is applied row-level here.
"""
from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evlens.functions.cohort import where_cohort
from evlens.functions.periods import extended_start, parse_day
from evlens.functions.timecols import shard_to_date
from evlens.schema import NAME, USER
from evlens.sources.scan import extended_scan, scan

# --- fixed values (must match the reference behaviour) -------------------------
AXES = (
    ("geo.country", "country"),
    ("platform", "platform"),
    ("app_info.version", "app version"),
    ("device.category", "device category"),
)
AXIS_TOP = 5
CONCENTRATION = 0.6
CHANGE_THRESHOLD = 0.25
DEFAULT_TARGET = "session_start"
# -----------------------------------------------------------------------------------
_ALL, _DAY = "__all__", "__day__"


def target_event(metric_event: str | None = None, end_event: str | None = None) -> str:
    """Event an insight is about: its ``event``, else its ``end_event``, else the default."""
    return metric_event or end_event or DEFAULT_TARGET


def affected_users(events: DataFrame, target: str, start: str, end: str,
                   base_cohort: list[dict] | None = None) -> DataFrame:
    """Distinct users who fired ``target`` in the window (one row)."""
    rows = where_cohort(scan(events, start, end), base_cohort).where(F.col(NAME) == target)
    return rows.agg(F.count_distinct(USER).alias("total_users"))


def investigate_where(events: DataFrame, target: str, start: str, end: str,
                      base_cohort: list[dict] | None = None) -> DataFrame:
    """E9 + F18: per axis the top values by distinct users of ``target``, the share of
    all affected users, and whether the top value concentrates >= 60 % of them.

    One scan: the four axes are unpivoted with ``stack`` next to a constant "all"
    axis whose single group is the denominator, grouped once by (axis, value).
    Ranking and the denominator use windows over that small grouped result.
    Columns: axis, rank, value, users, share, concentrated, total_affected_users.
    """
    rows = where_cohort(scan(events, start, end), base_cohort).where(F.col(NAME) == target)
    pairs = ", ".join(f"'{label}', `{field.split('.')[0]}`.`{field.split('.')[1]}`" if "." in field
                      else f"'{label}', `{field}`" for field, label in AXES)
    stacked = rows.select(USER, F.expr(f"stack({len(AXES) + 1}, {pairs}, '{_ALL}', '{_ALL}') as (axis, value)"))
    counted = (stacked.where(F.col("value").isNotNull() & (F.col("value") != ""))
               .groupBy("axis", "value").agg(F.count_distinct(USER).alias("users")))
    total = F.max(F.when(F.col("axis") == _ALL, F.col("users"))).over(Window.partitionBy(F.lit(1)))
    rank = F.row_number().over(Window.partitionBy("axis").orderBy(F.col("users").desc(), F.col("value").asc()))
    ranked = (counted.withColumn("total_affected_users", F.coalesce(total, F.lit(0)).cast("long"))
              .where((F.col("axis") != _ALL) & (F.col("total_affected_users") > 0))
              .withColumn("rank", rank).where(F.col("rank") <= AXIS_TOP))
    share = F.col("users") / F.col("total_affected_users")
    return ranked.select("axis", "rank", "value", "users", share.alias("share"),
                         ((F.col("rank") == 1) & (share >= CONCENTRATION)).alias("concentrated"),
                         "total_affected_users")


def _targets(insights: DataFrame) -> DataFrame:
    """(insight id, target event) of insight rows."""
    return insights.select(F.col("id").alias("insight_id"),
                           F.coalesce(F.nullif("event", F.lit("")), F.nullif("end_event", F.lit("")), F.lit(DEFAULT_TARGET))
                           .alias("target")).distinct()


def investigate_insights(events: DataFrame, insights: DataFrame, start: str, end: str,
                         base_cohort: list[dict] | None = None) -> DataFrame:
    """F18 + F19 for every row of an insight table (``insights.INSIGHT_COLUMNS``), in one pass.

    Rows of the analysis window and of the equally long one before it that are some
    insight's target are reduced once to (event, axis, value, user): the axes are unpivoted
    with ``stack``, next to an "all" axis for the denominator and a "day" axis for the
    timeline. Days on which anything happened, but not the target, come from a second,
    narrow scan of the shard days. All else are windows per target over these counts, so
    the cost does not depend on the number of insights, and those of one target share it.

    One row per insight and finding: ``section`` is "where" (axis, rank, value, users,
    share, concentrated, total_affected_users) or "when" (baseline, change_started_on).
    """
    targets = _targets(insights)
    names = targets.select(F.col("target").alias(NAME)).distinct()
    window = where_cohort(extended_scan(events, start, end), base_cohort)
    axes = [(label, f"`{field.split('.')[0]}`.`{field.split('.')[1]}`" if "." in field else f"`{field}`") for field, label in AXES]
    pairs = ", ".join(f"'{label}', {column}" for label, column in axes)
    counted = (window.join(names, NAME, "left_semi")
               .select(NAME, USER, F.col("event_date"),
                       F.expr(f"stack({len(AXES) + 2}, {pairs}, '{_ALL}', '{_ALL}', '{_DAY}', event_date) as (axis, value)"))
               .where((F.col("axis") == _DAY) | ((F.col("event_date") >= start) & F.col("value").isNotNull() & (F.col("value") != "")))
               .groupBy(NAME, "axis", "value", USER).agg(F.count(F.lit(1)).alias("n")))
    # Every target has every day with any event; two windows' days bound the grid of a target.
    days = names.withColumn("value", F.explode(F.array(*[F.lit(d) for d in _shards(extended_start(start, end), end)])))
    grid = (days.join(window.select(F.col("event_date").alias("value")).distinct(), "value", "left_semi")
            .select(NAME, F.lit(_DAY).alias("axis"), "value", F.lit(None).cast("string").alias(USER), F.lit(0).cast("long").alias("n")))
    facts = (counted.unionByName(grid).groupBy(NAME, "axis", "value")
             .agg(F.count(USER).alias("users"), F.sum("n").alias("n")))

    target = Window.partitionBy(NAME)
    is_day, before = F.col("axis") == _DAY, F.col("value") < start
    ranked = facts.select(
        "*", F.coalesce(F.max(F.when(F.col("axis") == _ALL, F.col("users"))).over(target), F.lit(0)).alias("total_affected_users"),
        F.avg(F.when(is_day & before, F.col("n"))).over(target).alias("mean"),
        F.count(F.when(is_day & ~before, F.lit(1))).over(target).alias("after"),
        F.row_number().over(Window.partitionBy(NAME, "axis").orderBy(F.col("users").desc(), F.col("value").asc())).alias("place"))
    baseline = F.when(F.col("after") > 0, F.when(F.col("mean") == 0, F.lit(1.0)).otherwise(F.col("mean")))
    moved = F.abs(F.col("n") - F.col("baseline")) / F.greatest(F.col("baseline"), F.lit(1.0)) >= CHANGE_THRESHOLD
    changed = (ranked.withColumn("baseline", baseline)
               .withColumn("change_started_on", F.min(F.when(is_day & ~before & moved, shard_to_date(F.col("value")))).over(target)))
    share = F.col("users") / F.nullif("total_affected_users", F.lit(0))
    axis_only = lambda c: F.when(~is_day, c)
    found = (changed.where((is_day & (F.col("place") == 1))
                           | (~is_day & (F.col("axis") != _ALL) & (F.col("place") <= AXIS_TOP) & (F.col("total_affected_users") > 0)))
             .select(F.col(NAME).alias("target"), F.when(is_day, F.lit("when")).otherwise(F.lit("where")).alias("section"),
                     axis_only(F.col("axis")).alias("axis"), axis_only(F.col("place")).alias("rank"), axis_only(F.col("value")).alias("value"),
                     axis_only(F.col("users")).alias("users"), axis_only(share).alias("share"),
                     axis_only((F.col("place") == 1) & (share >= CONCENTRATION)).alias("concentrated"),
                     axis_only(F.col("total_affected_users")).alias("total_affected_users"),
                     F.when(is_day, F.col("baseline")).alias("baseline"),
                     F.when(is_day, F.col("change_started_on")).alias("change_started_on")))
    return targets.join(found, "target").select("insight_id", *found.columns)


def _shards(start: str, end: str) -> list[str]:
    """Every day of a range as a shard name."""
    first, last = parse_day(start), parse_day(end)
    return [f"{first + timedelta(days=i):%Y%m%d}" for i in range((last - first).days + 1)]


def investigate_when(events: DataFrame, target: str, start: str, end: str,
                     base_cohort: list[dict] | None = None) -> DataFrame:
    """Per shard day of the analysis window and an equally long window before
    it: distinct users and rows of ``target``. Columns: date, dau, target_count."""
    rows = where_cohort(extended_scan(events, start, end), base_cohort)
    return (rows.groupBy(shard_to_date(F.col("event_date")).alias("date"))
            .agg(F.count_distinct(USER).alias("dau"),
                 F.count_if(F.col(NAME) == target).alias("target_count"))
            .orderBy("date"))


def change_day(timeline: DataFrame, start: str, end: str) -> DataFrame:
    """baseline = mean target count of the days before ``start`` present in the
    timeline (a zero mean counts as 1); change day = first day from ``start`` on with
    |count - baseline| / max(baseline, 1) >= 25 %. One row; NULLs when either side
    of the split has no days. The timeline has one row per day, so the windows
    here run over a few dozen rows.
    """
    split = F.to_date(F.lit(start), "yyyyMMdd")
    before = F.col("date") < split
    everything = Window.partitionBy(F.lit(1))
    t = (timeline.withColumn("_mean", F.avg(F.when(before, F.col("target_count"))).over(everything))
         .withColumn("_n_after", F.count(F.when(~before, F.lit(1))).over(everything)))
    baseline = F.when(F.col("_mean") == 0, F.lit(1.0)).otherwise(F.col("_mean"))
    moved = (F.abs(F.col("target_count") - baseline) / F.greatest(baseline, F.lit(1.0))) >= CHANGE_THRESHOLD
    t = t.withColumn("baseline", F.when(F.col("_n_after") > 0, baseline))
    return t.agg(
        F.lit(extended_start(start, end)).alias("baseline_start"), F.lit(start).alias("analysis_start"),
        F.lit(end).alias("analysis_end"),
        F.max("baseline").alias("baseline"),
        F.min(F.when(~before & moved & F.col("baseline").isNotNull(), F.col("date"))).alias("change_started_on"))
