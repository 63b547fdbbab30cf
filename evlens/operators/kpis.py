"""Dashboard KPIs (F20), deltas (F21, F22), growth check (F23), freshness status
and relative bar length (F31)."""
from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evlens.functions.cohort import cohort_predicate
from evlens.functions.literals import literal_frame
from evlens.functions.periods import parse_day, previous_period
from evlens.functions.timecols import shard_to_date, utc_day
from evlens.schema import DATE, MICROS_PER_HOUR, NAME, USER
from evlens.sources.scan import tag_periods

# --- fixed values (must match the reference behaviour) -------------------------
FLAT_PCT = 0.5          # |% change| within this band is "flat"
FLAT_PP = 0.05          # |pp change| within this band is "flat"
GROWTH_MIN_DAYS, GROWTH_WEEK = 14, 7
FRESH_HOURS, STALE_HOURS = 30, 72
RETURN_DAY = 7          # a user is retained with an event this many UTC days after the first
# -----------------------------------------------------------------------------------


def _user_rows(events: DataFrame, periods: dict[str, tuple[str, str]], cohort: list[dict] | None, *keys: str) -> DataFrame:
    """Rows per (period, user, UTC day, ``keys``) of one scan, each with its user's facts in that period.

    ``n``: event rows; ``one_user``: true on one row of each user; ``back``: the user came back on
    day 7. A cohort is evaluated separately inside each period; only its members' rows are left.
    Rows without a user count as events, never as users, and are in no cohort. The windows
    run on the partial aggregate, so a user has at most a row per day and keys.
    """
    pred, known = cohort_predicate(cohort), F.col(USER).isNotNull()
    hit = F.lit(True) if pred is None else F.coalesce(pred & known, F.lit(False))
    parts = (tag_periods(events, periods).groupBy("period", USER, utc_day().alias("day"), *keys)
             .agg(F.count(F.lit(1)).alias("n"), F.max(hit).alias("hit")))
    user = Window.partitionBy("period", USER)
    return (parts.withColumns({"cohort_day": F.min("day").over(user), "member": F.max("hit").over(user),
                               "one_user": known & (F.row_number().over(user.orderBy("day", *keys)) == 1)})
            .withColumn("back", F.max(F.col("day") == F.col("cohort_day") + RETURN_DAY).over(user))
            .where("member"))


def dashboard_kpis(events: DataFrame, start: str, end: str, cohort: list[dict] | None = None,
                   compare: bool = True) -> DataFrame:
    """per period (``current`` and, with ``compare``, ``previous``): active users,
    total events, weighted D7 retention, D7 retained users and cohorted users.

    One scan covers both periods, the cohort included (``_user_rows``). Top events and the
    DAU series are ``events.top_events(limit=5)`` and ``events.daily_activity`` on the same window.
    """
    periods = _periods(start, end, compare)
    sums = _user_rows(events, periods, cohort).groupBy("period").agg(
        F.count_if("one_user").alias("users"), F.sum("n").alias("n"),
        F.count_if(F.col("one_user") & F.col("back")).alias("back"))
    frame = literal_frame(events.sparkSession,
                          [("period", "string"), ("period_start", "string"), ("period_end", "string")],
                          [(k, s, e) for k, (s, e) in periods.items()])
    users, back = (F.coalesce(c, F.lit(0)).cast("long") for c in ("users", "back"))
    return frame.join(sums, "period", "left").select(
        "period", "period_start", "period_end", users.alias("active_users"),
        F.coalesce("n", F.lit(0)).cast("long").alias("total_events"), _rate(back, users).alias("d7_rate"),
        back.alias("d7_retained"), users.alias("total_cohorted"))


def _periods(start: str, end: str, compare: bool) -> dict[str, tuple[str, str]]:
    current = {"current": (start, end)}
    return current | {"previous": previous_period(start, end)} if compare else current


def _rate(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def pct_delta(cur: Column, prev: Column) -> tuple[Column, Column, Column]:
    """(pct rounded to 1 decimal, direction, absolute) of a count KPI."""
    pct = (cur - prev).cast("double") / prev * 100
    direction = (F.when(cur.isNull() | prev.isNull(), F.lit(None))
                 .when(prev == 0, F.when(cur == 0, F.lit("flat")).otherwise(F.lit("up")))
                 .when(pct > FLAT_PCT, F.lit("up")).when(pct < -FLAT_PCT, F.lit("down")).otherwise(F.lit("flat")))
    pct_out = (F.when(cur.isNull() | prev.isNull(), F.lit(None))
               .when(prev == 0, F.when(cur == 0, F.lit(0.0)))
               .otherwise(F.bround(pct, 1)))
    absolute = F.when(cur.isNull() | prev.isNull(), F.lit(None)).otherwise(cur - prev)
    return pct_out.cast("double"), direction, absolute.cast("long")


def pp_delta(cur: Column, prev: Column) -> tuple[Column, Column]:
    """D7 change in percentage points (rounded to 1) and its direction."""
    pp = (cur - prev) * 100
    both = cur.isNotNull() & prev.isNotNull()
    direction = (F.when(~both, F.lit(None)).when(pp > FLAT_PP, F.lit("up"))
                 .when(pp < -FLAT_PP, F.lit("down")).otherwise(F.lit("flat")))
    return F.when(both, F.bround(pp, 1)).cast("double"), direction


def kpi_deltas(kpis: DataFrame) -> DataFrame:
    """F21 + F22 from the two-row ``dashboard_kpis`` result: one row per KPI with
    current, previous, pct / pp, direction and absolute change."""
    cur = {c: F.max(F.when(F.col("period") == "current", F.col(c))) for c in ("active_users", "total_events", "d7_rate")}
    prev = {c: F.max(F.when(F.col("period") == "previous", F.col(c))) for c in ("active_users", "total_events", "d7_rate")}
    wide = kpis.agg(*[v.alias(f"cur_{k}") for k, v in cur.items()], *[v.alias(f"prev_{k}") for k, v in prev.items()])
    rows = []
    for k in ("active_users", "total_events"):
        c, p = F.col(f"cur_{k}"), F.col(f"prev_{k}")
        pct, direction, absolute = pct_delta(c, p)
        rows.append(F.struct(F.lit(k).alias("kpi"), c.cast("double").alias("current_value"),
                             p.cast("double").alias("previous_value"), pct.alias("pct"),
                             F.lit(None).cast("double").alias("pp"), direction.alias("direction"),
                             absolute.alias("absolute")))
    c, p = F.col("cur_d7_rate"), F.col("prev_d7_rate")
    pp, direction = pp_delta(c, p)
    rows.append(F.struct(F.lit("d7_rate").alias("kpi"), c.alias("current_value"), p.alias("previous_value"),
                         F.lit(None).cast("double").alias("pct"), pp.alias("pp"), direction.alias("direction"),
                         F.lit(None).cast("long").alias("absolute")))
    return wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def growth_check(daily: DataFrame) -> DataFrame:
    """mean DAU of the first 7 vs last 7 day rows of a ``daily_activity`` result;
    needs at least 14 rows. One row: days, first_week_avg, last_week_avg, rel_change,
    direction (NULLs when there are too few days)."""
    asc = F.row_number().over(Window.orderBy(F.col("day").asc()))
    desc = F.row_number().over(Window.orderBy(F.col("day").desc()))
    d = daily.withColumn("_a", asc).withColumn("_d", desc)
    agg = d.agg(F.count(F.lit(1)).alias("days"),
                (F.sum(F.when(F.col("_a") <= GROWTH_WEEK, F.col("dau"))) / GROWTH_WEEK).alias("fw"),
                (F.sum(F.when(F.col("_d") <= GROWTH_WEEK, F.col("dau"))) / GROWTH_WEEK).alias("lw"))
    enough = F.col("days") >= GROWTH_MIN_DAYS
    rel = F.when(F.col("fw") != 0, (F.col("lw") - F.col("fw")) / F.col("fw")).otherwise(F.lit(0.0))
    return agg.select("days",
                      F.when(enough, F.col("fw")).cast("double").alias("first_week_avg"),
                      F.when(enough, F.col("lw")).cast("double").alias("last_week_avg"),
                      F.when(enough, rel).cast("double").alias("rel_change"),
                      F.when(enough, F.when(rel >= 0, F.lit("up")).otherwise(F.lit("down"))).alias("direction"))


def freshness_status(fresh: DataFrame, as_of: datetime) -> DataFrame:
    """hours since the latest event (rounded to 1) and fresh / stale / broken;
    ``no_data`` when nothing was found. ``fresh`` is the ``events.freshness`` row."""
    if as_of.tzinfo is None:
        as_of = as_of.replace(tzinfo=timezone.utc)
    now_us = int(as_of.timestamp()) * 1_000_000 + as_of.microsecond
    hours = F.bround((F.lit(now_us) - F.col("latest_event")) / F.lit(MICROS_PER_HOUR), 1)
    status = (F.when(F.col("latest_event").isNull(), F.lit("no_data"))
              .when(hours < FRESH_HOURS, F.lit("fresh")).when(hours < STALE_HOURS, F.lit("stale"))
              .otherwise(F.lit("broken")))
    return fresh.select(status.alias("status"), "latest_event", hours.cast("double").alias("hours_old"),
                        "days_with_data")


def relative_share(df: DataFrame, value_col: str = "unique_users", out_col: str = "bar_pct") -> DataFrame:
    """value / max(value) * 100 over a small ranked result (e.g. top events)."""
    m = F.max(value_col).over(Window.partitionBy(F.lit(1)))
    # All values 0: there is no longest bar, and no share of it.
    return df.withColumn(out_col, (F.try_divide(F.col(value_col), m) * 100).cast("double"))


def dashboard_overview(events: DataFrame, start: str, end: str, cohort: list[dict] | None = None,
                       top_n: int = 5, compare: bool = True) -> DataFrame:
    """F20-F22 as one row for the window: the current KPIs, the top ``top_n`` events by
    rows, the daily-active-users series and, with ``compare``, the previous period's
    KPIs with the deltas (``*_pct`` / ``d7_pp`` and directions).

    One scan: the rows of ``_user_rows`` per event and shard day are summed per period, per
    event and per day in one tagged aggregate. Of it only what the result shows is
    folded into the row: the ``top_n`` events and one point per day of the window.
    """
    periods = _periods(start, end, compare)
    rows = _user_rows(events, periods, cohort, DATE, NAME)
    known, current = F.col(USER).isNotNull(), F.col("period") == "current"
    once = lambda key, rest: known & (F.row_number().over(
        Window.partitionBy("period", USER, key).orderBy("day", rest)) == 1)
    rows = rows.withColumns({"one_on_day": once(DATE, NAME), "one_of_event": once(NAME, DATE)})
    no = F.lit(False)
    fact = lambda tag, key, users, back: F.struct(
        F.lit(tag).alias("tag"), key.cast("string").alias("key"), users.alias("one"), back.alias("back"))
    total = fact("total", F.lit(None), F.col("one_user"), F.col("one_user") & F.col("back"))
    day = fact("day", shard_to_date(F.col(DATE)), F.col("one_on_day"), no)
    event = fact("event", F.col(NAME), F.col("one_of_event"), no)
    sums = (rows.select("period", "n", F.explode(F.when(current, F.array(total, day, event)).otherwise(F.array(total))).alias("f"))
            .groupBy("period", "f.tag", "f.key")
            .agg(F.sum("n").alias("n"), F.count_if("f.one").alias("users"), F.count_if("f.back").alias("back")))
    place = F.row_number().over(Window.partitionBy("period", "tag").orderBy(F.col("n").desc(), F.col("key").asc_nulls_last()))
    days = (parse_day(end) - parse_day(start)).days + 1
    shown = sums.withColumn("place", place).where(F.col("place") <= max(top_n, days))

    at = lambda period, c: F.coalesce(
        F.max(F.when((F.col("period") == period) & (F.col("tag") == "total"), F.col(c))), F.lit(0)).cast("long")
    a_top = F.struct("place", F.col("key").alias("event_name"), F.col("n").alias("event_count"), F.col("users").alias("unique_users"))
    a_day = F.struct(F.col("key").cast("date").alias("day"), F.col("users").alias("value"))
    wide = shown.agg(*[at(p, c).alias(f"{p}_{c}") for p in periods for c in ("users", "n", "back")],
                     F.array_sort(F.collect_list(F.when(F.col("tag") == "event", a_top))).alias("tops"),
                     F.array_sort(F.collect_list(F.when(F.col("tag") == "day", a_day))).alias("sparkline"))
    col = F.col
    out = [F.lit(start).alias("period_start"), F.lit(end).alias("period_end"),
           col("current_users").alias("active_users"), col("current_n").alias("total_events"),
           _rate(col("current_back"), col("current_users")).alias("d7_rate"), col("current_back").alias("d7_retained"),
           col("current_users").alias("total_cohorted"),
           F.transform(F.slice("tops", 1, top_n),
                       lambda t: F.struct(t["event_name"], t["event_count"], t["unique_users"])).alias("top_events"),
           col("sparkline")]
    if not compare:
        return wide.select(*out)
    out += [F.lit(periods["previous"][0]).alias("prev_period_start"), F.lit(periods["previous"][1]).alias("prev_period_end"),
            col("previous_users").alias("prev_active_users"), col("previous_n").alias("prev_total_events"),
            _rate(col("previous_back"), col("previous_users")).alias("prev_d7_rate")]
    merged = wide.select(*out)
    deltas = []
    for k in ("active_users", "total_events"):
        pct, direction, _ = pct_delta(col(k), col(f"prev_{k}"))
        deltas += [pct.alias(f"{k}_pct"), direction.alias(f"{k}_direction")]
    pp, direction = pp_delta(col("d7_rate"), col("prev_d7_rate"))
    return merged.select("*", *deltas, pp.alias("d7_pp"), direction.alias("d7_direction"))
