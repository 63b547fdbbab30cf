"""Period comparisons (F7-F11) and insight rules.

Rules are functions ``DataFrame -> DataFrame`` producing rows of the insight shape
(``INSIGHT_COLUMNS`` plus ``position``, the row's place in the rule's own ranking);
``run_insights`` unions them and ranks by severity. A caller's own rules are functions
``Facts -> DataFrame`` of that shape, given as ``rules``; ``insight`` makes the columns.
"""
from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evlens.functions.periods import periods_from_range, shift, week_windows
from evlens.operators import events as E
from evlens.operators.funnel import check_steps, step_reached
from evlens.schema import MICROS_PER_DAY, MICROS_PER_HOUR, NAME, TS, USER
from evlens.sources.scan import scan, tag_periods

# --- fixed values (must match the reference behaviour) -------------------------
CONVERSION_MIN_REL = 0.05        # |relative change| needed for a conversion insight
CONVERSION_MIN_STARTS = 50       # starters needed this period
FUNNEL_MIN_DROP = 0.3            # worst step drop-off needed
RETENTION_MIN_LIFT = 0.1         # absolute D7 lift needed
VOLUME_MIN_REL = 0.25            # |relative change| needed for a volume insight
RULE_TOP = 3                     # rows of a ranked result a rule looks at
MIN_USERS = 50                   # support for correlation and volume change
CORRELATION_LIMIT = 10
VOLUME_LIMIT = 10
MOVERS_MIN_USERS, MOVERS_LIMIT = 30, 8
DAY1_HOURS = 24                  # whole hours after first seen that count as day 1
RETURN_DAY = 7
# -----------------------------------------------------------------------------------

INSIGHT_COLUMNS = ["id", "kind", "severity", "title", "detail", "event", "start_event", "end_event", "metric"]


def pct_text(x: Column) -> Column:
    """``{x*100:.1f}%`` (half-up at exact ties)."""
    return F.format_string("%.1f%%", F.round(x * 100, 1))


def insight(id_: Column, kind: str, severity: Column, title: Column, detail: Column,
            metric: dict[str, Column], event: Column | None = None,
            start_event: Column | None = None, end_event: Column | None = None) -> list[Column]:
    """The columns of an insight row, without ``position``."""
    null = F.lit(None).cast("string")
    keys, vals = zip(*metric.items())
    return [id_.alias("id"), F.lit(kind).alias("kind"), severity.cast("double").alias("severity"),
            title.alias("title"), detail.alias("detail"),
            (event if event is not None else null).alias("event"),
            (start_event if start_event is not None else null).alias("start_event"),
            (end_event if end_event is not None else null).alias("end_event"),
            F.map_from_arrays(F.array(*[F.lit(k) for k in keys]),
                              F.array(*[v.cast("double") for v in vals])).alias("metric")]


# ------------------------------------------------------------------ shared input shape
def user_event_days(events: DataFrame, start: str, end: str) -> DataFrame:
    """One partial aggregate of a window: per (shard day, user, event, UTC day) the
    first and last time and the row count. Every period comparison below can read
    it instead of raw events, so several rules over one window share one scan and
    one shuffle (``run_insights``)."""
    return (scan(events, start, end)
            .groupBy("event_date", USER, NAME, F.floor(F.col(TS) / MICROS_PER_DAY).alias("day"))
            .agg(F.min(TS).alias("first_t"), F.max(TS).alias("last_t"), F.count(F.lit(1)).alias("n")))


def _rows_as_days(events: DataFrame) -> DataFrame:
    """Raw events in the ``user_event_days`` shape, one row each (no aggregation)."""
    return events.select("event_date", USER, NAME, F.floor(F.col(TS) / MICROS_PER_DAY).alias("day"),
                         F.col(TS).alias("first_t"), F.col(TS).alias("last_t"), F.lit(1).alias("n"))


# ------------------------------------------------------------------ F7 conversion change
def _user_converted(buckets: DataFrame, window_days: int, ordered: bool) -> Column:
    """Per (period, user, day bucket k) with start times: does some end time b
    pair with a start time a of this bucket so that whole_days(b - a) is in
    [0, N] (``ordered``: additionally b >= a)?

    With buckets of one day, a in bucket k and b in bucket j:
      * j - k in [0, N] (ordered: [1, N]) - every such pair qualifies;
      * j = k - 1 (not ordered) - qualifies iff min(a) - max(b) <= 1 day - 1 us;
      * j = k (ordered)         - qualifies iff max(b) >= min(a);
      * j = k + N + 1           - qualifies iff min(b) - max(a) <= (N + 1) days - 1 us;
      * any other j never qualifies.
    So bucket-level min / max decide the pair test exactly.
    """
    n = window_days
    w = Window.partitionBy("period", USER).orderBy("b")
    lo_full = 1 if ordered else 0
    has_b = F.col("min_b").isNotNull()
    cond = F.lit(False)
    if n >= lo_full:
        cond = cond | F.coalesce(F.max(has_b).over(w.rangeBetween(lo_full, n)), F.lit(False))
    if ordered:
        cond = cond | F.coalesce(F.col("max_b") >= F.col("min_a"), F.lit(False))
    else:
        prev_max_b = F.max("max_b").over(w.rangeBetween(-1, -1))
        cond = cond | F.coalesce(F.col("min_a") - prev_max_b <= MICROS_PER_DAY - 1, F.lit(False))
    next_min_b = F.min("min_b").over(w.rangeBetween(n + 1, n + 1))
    cond = cond | F.coalesce(next_min_b - F.col("max_a") <= (n + 1) * MICROS_PER_DAY - 1, F.lit(False))
    return F.col("min_a").isNotNull() & cond


def conversion_change(events: DataFrame, start_event: str, end_event: str,
                      this: tuple[str, str], last: tuple[str, str],
                      window_days: int = 7, ordered: bool = False) -> DataFrame:
    """starters, converters and rates in two periods (one row).

    A starter is a user with ``start_event`` in the period; a converter has a start
    and an end event with whole_days(end - start) between 0 and ``window_days``
    (truncated toward zero, so an end up to 24 h *before* the start also counts
    unless ``ordered``).

    Plan: one scan of both periods, reduced to per (period, user, UTC day) min / max
    of start and end times - a partial aggregate, so a hot user costs one row per
    day and map task - then range windows over at most one row per day of the
    period decide the pair test exactly (see ``_user_converted``).
    """
    return _conversion(_rows_as_days(events), start_event, end_event, this, last, window_days, ordered)


def _conversion(days: DataFrame, start_event: str, end_event: str, this: tuple[str, str],
                last: tuple[str, str], window_days: int, ordered: bool) -> DataFrame:
    tagged = (tag_periods(days, {"this": this, "last": last})
              .where(F.col(NAME).isin(start_event, end_event) & F.col(USER).isNotNull()))
    is_a, is_b = F.col(NAME) == start_event, F.col(NAME) == end_event
    buckets = (tagged.groupBy("period", USER, F.col("day").alias("b"))
               .agg(F.min(F.when(is_a, F.col("first_t"))).alias("min_a"),
                    F.max(F.when(is_a, F.col("last_t"))).alias("max_a"),
                    F.min(F.when(is_b, F.col("first_t"))).alias("min_b"),
                    F.max(F.when(is_b, F.col("last_t"))).alias("max_b")))
    flagged = buckets.select("period", USER, F.col("min_a").isNotNull().alias("started"),
                             _user_converted(buckets, window_days, ordered).alias("converted"))
    per_user = flagged.groupBy("period", USER).agg(F.bool_or("started").alias("started"),
                                                   F.bool_or("converted").alias("converted"))
    p = F.col("period")
    out = per_user.agg(
        F.count_if((p == "this") & F.col("started")).alias("this_starts"),
        F.count_if((p == "this") & F.col("converted")).alias("this_finishes"),
        F.count_if((p == "last") & F.col("started")).alias("last_starts"),
        F.count_if((p == "last") & F.col("converted")).alias("last_finishes"))
    return out.select(
        "this_starts", "this_finishes",
        F.try_divide(F.col("this_finishes"), F.col("this_starts")).cast("double").alias("this_rate"),
        "last_starts", "last_finishes",
        F.try_divide(F.col("last_finishes"), F.col("last_starts")).cast("double").alias("last_rate"))


# ------------------------------------------------------------------ F8 retention correlation
def retention_correlation(events: DataFrame, start: str, end: str, min_users: int = MIN_USERS,
                          limit: int | None = CORRELATION_LIMIT) -> DataFrame:
    """F8: per event, D7 return rate of users who did / did not do it within 24 whole
    hours of first being seen; ranked by lift (with - without), top ``limit``.

    Plan: per (user, event, UTC day) minimum time (partial aggregate), then
    per-user windows over that reduced set - at most events x days rows per user -
    give first-seen time and the day-7 return flag. The users x events cross join
    of the literal form becomes a subtraction from per-user totals.
    """
    return _correlation(_rows_as_days(events), start, end, min_users, limit)


def _correlation(days: DataFrame, start: str, end: str, min_users: int, limit: int | None) -> DataFrame:
    window = scan(days, start, end).where(F.col(USER).isNotNull())
    ued = window.groupBy(USER, NAME, "day").agg(F.min("first_t").alias("mt"))
    wu = Window.partitionBy(USER)
    ued = ued.withColumn("first_t", F.min("mt").over(wu))
    ued = ued.withColumn("returned", F.max(
        F.col("day") == F.floor(F.col("first_t") / MICROS_PER_DAY) + RETURN_DAY).over(wu))
    day1 = (ued.where(F.col(NAME).isNotNull()
                      & (F.col("mt") - F.col("first_t") < (DAY1_HOURS + 1) * MICROS_PER_HOUR))
            .select(USER, NAME, "returned").distinct()
            .select(NAME, "returned", F.lit(False).alias("_total")))
    users = (ued.select(USER, "returned").distinct()
             .select(F.lit(None).cast("string").alias(NAME), "returned", F.lit(True).alias("_total")))
    counts = (day1.unionByName(users).groupBy("_total", NAME)
              .agg(F.count(F.lit(1)).alias("n"), F.count_if("returned").alias("nr")))
    # Totals ride along on a window over the already reduced result (events + 1 rows).
    everything = Window.partitionBy(F.lit(1))
    counts = (counts.withColumn("tot", F.max(F.when(F.col("_total"), F.col("n"))).over(everything))
              .withColumn("tot_ret", F.max(F.when(F.col("_total"), F.col("nr"))).over(everything))
              .where(~F.col("_total")))
    did, no = F.col("n"), F.coalesce(F.col("tot"), F.lit(0)) - F.col("n")
    with_r = F.try_divide(F.col("nr"), F.nullif(did, F.lit(0))).cast("double")
    without_r = F.try_divide(F.coalesce(F.col("tot_ret"), F.lit(0)) - F.col("nr"), F.nullif(no, F.lit(0))).cast("double")
    out = (counts.select(NAME, did.alias("did_event_users"), no.alias("no_event_users"),
                         with_r.alias("d7_retention_with_event"), without_r.alias("d7_retention_without_event"))
           .where((F.col("did_event_users") >= min_users) & (F.col("no_event_users") >= min_users))
           .withColumn("lift", F.col("d7_retention_with_event") - F.col("d7_retention_without_event")))
    out = out.orderBy(F.col("lift").desc_nulls_last(), F.col(NAME).asc())
    return out if limit is None else out.limit(limit)


# ------------------------------------------------------------------ F9 / F10 volume change
def _period_users(days: DataFrame, this: tuple[str, str], prev: tuple[str, str]) -> DataFrame:
    """Distinct users per event in two periods from one scan (NULL names excluded)."""
    tagged = tag_periods(days, {"this": this, "prev": prev}).where(F.col(NAME).isNotNull())
    pairs = tagged.select("period", NAME, USER).distinct()
    p, has_user = F.col("period"), F.col(USER).isNotNull()
    return pairs.groupBy(NAME).agg(F.count_if((p == "this") & has_user).alias("this_users"),
                                   F.count_if((p == "prev") & has_user).alias("prev_users"))


def _ranked_change(per_event: DataFrame, min_users: int, limit: int | None) -> DataFrame:
    pct = F.try_divide(F.col("this_users") - F.col("prev_users"),
                       F.nullif(F.col("prev_users"), F.lit(0))).cast("double")
    out = (per_event.where(F.col("prev_users") >= min_users).withColumn("pct_change", pct)
           .orderBy(F.abs(F.coalesce(F.col("pct_change"), F.lit(0.0))).desc(), F.col(NAME).asc()))
    return out if limit is None else out.limit(limit)


def event_volume_change(events: DataFrame, this: tuple[str, str], last: tuple[str, str],
                        min_users: int = MIN_USERS, limit: int | None = VOLUME_LIMIT) -> DataFrame:
    """distinct users per event this vs last period, largest relative moves first.

    Events new this period are dropped (they need ``min_users`` last period).
    Columns: event_name, this_users, last_users, pct_change.
    """
    return _volume(_rows_as_days(events), this, last, min_users, limit)


def _volume(days: DataFrame, this, last, min_users: int, limit: int | None) -> DataFrame:
    out = _ranked_change(_period_users(days, this, last), min_users, limit)
    return out.select(NAME, "this_users", F.col("prev_users").alias("last_users"), "pct_change")


def adjacent_movers(events: DataFrame, start: str, end: str, min_users: int = MOVERS_MIN_USERS,
                    limit: int = MOVERS_LIMIT) -> DataFrame:
    """volume change of the current period against the equally long one before."""
    ts, te, ps, pe = periods_from_range(start, end)
    return _ranked_change(_period_users(_rows_as_days(events), (ts, te), (ps, pe)), min_users, limit).select(
        NAME, "this_users", "prev_users", "pct_change")


def explain_context(events: DataFrame, start: str, end: str, kind: str) -> DataFrame:
    """grounding numbers for one insight: top 10 events by rows (with their
    distinct users) and, for conversion / funnel insights, the adjacent movers.

    Columns: section, position, event_name, users, this_users, prev_users, pct_change.
    """
    null_l = F.lit(None).cast("long")
    rank_top = Window.orderBy(F.col("event_count").desc(), F.col(NAME).asc())
    top = (E.top_events(events, start, end, limit=10)
           .select(F.lit("top_events").alias("section"), F.row_number().over(rank_top).alias("position"),
                   NAME, F.col("unique_users").alias("users"), null_l.alias("this_users"),
                   null_l.alias("prev_users"), F.lit(None).cast("double").alias("pct_change")))
    if kind not in ("conversion", "funnel"):
        return top
    mv = adjacent_movers(events, start, end)
    rank_mv = Window.orderBy(F.abs(F.coalesce(F.col("pct_change"), F.lit(0.0))).desc(), F.col(NAME).asc())
    movers = mv.select(F.lit("adjacent_movers").alias("section"), F.row_number().over(rank_mv).alias("position"),
                       NAME, null_l.alias("users"), "this_users", "prev_users",
                       F.coalesce(F.col("pct_change"), F.lit(0.0)).alias("pct_change"))
    return top.unionByName(movers)


# ------------------------------------------------------------------ F12-F15 rules
# What a rule says of a row of its ranked result, wherever that row comes from: (gate, insight columns).
def _say_conversion(start_event: str, end_event: str, period_label: str = "vs previous period",
                    min_rel: float = CONVERSION_MIN_REL, min_starts: int = CONVERSION_MIN_STARTS) -> tuple[Column, list[Column]]:
    this_r, last_r = F.coalesce(F.col("this_rate"), F.lit(0.0)), F.coalesce(F.col("last_rate"), F.lit(0.0))
    rel = F.try_divide(this_r - last_r, last_r)
    direction = F.when(this_r - last_r < 0, F.lit("dropped")).otherwise(F.lit("increased"))
    gate = (last_r != 0) & (F.abs(rel) >= min_rel) & (F.coalesce(F.col("this_starts"), F.lit(0)) >= min_starts)
    title = F.concat_ws(" ", F.lit(f"{start_event} → {end_event} conversion"), direction,
                        pct_text(F.abs(rel)), F.lit(period_label))
    detail = F.concat(F.lit("This period: "), pct_text(this_r), F.lit(" ("),
                      F.col("this_finishes").cast("string"), F.lit(" of "), F.col("this_starts").cast("string"),
                      F.lit(" users). Previous: "), pct_text(last_r), F.lit(" ("),
                      F.col("last_finishes").cast("string"), F.lit(" of "), F.col("last_starts").cast("string"),
                      F.lit(")."))
    return gate, insight(
        F.lit(f"conv_change_{start_event}_{end_event}"), "conversion", F.least(F.lit(1.0), F.abs(rel) * 2),
        title, detail,
        {"this_rate": this_r, "last_rate": last_r, "rel_change": rel,
         "this_starts": F.col("this_starts"), "this_finishes": F.col("this_finishes")},
        start_event=F.lit(start_event), end_event=F.lit(end_event))


def _say_funnel_drop() -> tuple[Column, list[Column]]:
    d = F.col("drop_off_from_prev_pct")
    title = F.concat(F.lit('Biggest drop-off is at "'), F.col("event"), F.lit('" ('), pct_text(d), F.lit(")"))
    detail = F.concat(F.lit("Only "), F.col("users").cast("string"),
                      F.lit(" of the previous step's users continued to "), F.col("event"),
                      F.lit(". This is the single biggest leak in the funnel."))
    return d >= FUNNEL_MIN_DROP, insight(
        F.concat(F.lit("funnel_drop_"), F.col("event")), "funnel", F.least(F.lit(1.0), d), title, detail,
        {"step": F.col("step_index"), "users": F.col("users"), "drop_off_pct": d}, event=F.col("event"))


def _say_retention(min_lift: float = RETENTION_MIN_LIFT) -> tuple[Column, list[Column]]:
    w_r = F.coalesce(F.col("d7_retention_with_event"), F.lit(0.0))
    wo_r = F.coalesce(F.col("d7_retention_without_event"), F.lit(0.0))
    lift = w_r - wo_r
    lift_pp = F.format_string("%.1f", F.round(lift * 100, 1))
    title = F.concat(F.lit('Users who do "'), F.col(NAME), F.lit('" on day 1 retain '), lift_pp,
                     F.lit("pp better at D7"))
    detail = F.concat(F.lit("D7 retention with event: "), pct_text(w_r), F.lit(" ("),
                      F.col("did_event_users").cast("string"), F.lit(" users). Without: "), pct_text(wo_r),
                      F.lit(" ("), F.col("no_event_users").cast("string"), F.lit(" users). Lift: +"), lift_pp,
                      F.lit(" percentage points."))
    return lift >= min_lift, insight(
        F.concat(F.lit("ret_corr_"), F.col(NAME)), "retention", F.least(F.lit(1.0), lift * 2), title, detail,
        {"d7_with": w_r, "d7_without": wo_r, "lift": lift}, event=F.col(NAME))


def _say_volume(period_label: str = "this period", min_rel: float = VOLUME_MIN_REL) -> tuple[Column, list[Column]]:
    rel = F.coalesce(F.col("pct_change"), F.lit(0.0))
    direction = F.when(rel > 0, F.lit("spiked")).otherwise(F.lit("dropped"))
    title = F.concat(F.lit('"'), F.col(NAME), F.lit('" '), direction, F.lit(" "), pct_text(F.abs(rel)),
                     F.lit(" " + period_label))
    detail = F.concat(F.lit("This period: "), F.col("this_users").cast("string"), F.lit(" users. Previous: "),
                      F.col("last_users").cast("string"), F.lit(" users."))
    return F.abs(rel) >= min_rel, insight(
        F.concat(F.lit("vol_"), F.col(NAME)), "volume", F.least(F.lit(1.0), F.abs(rel)), title, detail,
        {"this": F.col("this_users"), "last": F.col("last_users"), "rel_change": rel}, event=F.col(NAME))


def rule_conversion(conv: DataFrame, start_event: str, end_event: str,
                    period_label: str = "vs previous period", min_rel: float = CONVERSION_MIN_REL,
                    min_starts: int = CONVERSION_MIN_STARTS) -> DataFrame:
    """conversion insight from the one-row ``conversion_change`` result."""
    gate, cols = _say_conversion(start_event, end_event, period_label, min_rel, min_starts)
    return conv.where(gate).select(*cols, F.lit(1).alias("position"))


def rule_funnel_drop(steps: DataFrame) -> DataFrame:
    """worst funnel step - the first strict maximum of drop-off - if >= 30 %."""
    d = F.col("drop_off_from_prev_pct")
    gate, cols = _say_funnel_drop()
    worst = _first_rows(steps.where((F.col("step_index") > 1) & d.isNotNull()), [d.desc(), F.col("step_index").asc()], 1)
    return worst.where(gate).select(*cols, F.lit(1).alias("position"))


def _first_rows(ranked: DataFrame, order: list[Column], n: int = RULE_TOP) -> DataFrame:
    """The first ``n`` rows of an already ranked (small, limited) result."""
    return ranked.withColumn("_rn", F.row_number().over(Window.orderBy(*order))).where(F.col("_rn") <= n)


def rule_retention(corr: DataFrame, min_lift: float = RETENTION_MIN_LIFT) -> DataFrame:
    """of the first three correlation rows, those with lift >= ``min_lift`` (10 pp)."""
    gate, cols = _say_retention(min_lift)
    top = _first_rows(corr, [F.col("lift").desc_nulls_last(), F.col(NAME).asc()])
    return top.where(gate).select(*cols, F.col("_rn").cast("int").alias("position"))


def rule_volume(vol: DataFrame, period_label: str = "this period", min_rel: float = VOLUME_MIN_REL) -> DataFrame:
    """of the first three volume rows, moves of at least ``min_rel`` (25 %)."""
    gate, cols = _say_volume(period_label, min_rel)
    top = _first_rows(vol, [F.abs(F.coalesce(F.col("pct_change"), F.lit(0.0))).desc(), F.col(NAME).asc()])
    return top.where(gate).select(*cols, F.col("_rn").cast("int").alias("position"))


# ------------------------------------------------------------------ a caller's own rules
@dataclass(frozen=True)
class Facts:
    """What the rules of one run read: one reduced table and the two periods.

    ``days`` has the columns of ``user_event_days``. In weekly mode it reaches back
    further than the periods; ``period`` cuts it to either of them.
    """
    days: DataFrame
    this: tuple[str, str]
    previous: tuple[str, str]

    def period(self) -> Column:
        """'this', 'previous', or NULL outside both."""
        day = F.col("event_date")
        return F.when(day.between(*self.this), F.lit("this")).when(day.between(*self.previous), F.lit("previous"))


Rule = Callable[[Facts], DataFrame]


def apply_rules(facts: Facts, rules: Sequence[Rule]) -> list[DataFrame]:
    """Each rule's rows in the insight shape; a rule that lacks one of its columns is an error, more columns are dropped."""
    parts = []
    for rule in rules:
        rows = rule(facts)
        lacking = [c for c in (*INSIGHT_COLUMNS, "position") if c not in rows.columns]
        if lacking:
            raise ValueError(f"rule {getattr(rule, '__name__', rule)!s} returns no column {', '.join(lacking)}")
        parts.append(rows.select(*INSIGHT_COLUMNS, F.col("position").cast("int").alias("position")))
    return parts


# ------------------------------------------------------------------ F16 orchestration
@dataclass(frozen=True)
class Windows:
    """The date ranges of one run: two periods, the correlation's window, and the funnel's."""
    this: tuple[str, str]
    previous: tuple[str, str]
    correlation: tuple[str, str]
    funnel: tuple[str, str]

    def span(self) -> tuple[str, str]:
        every = (self.this, self.previous, self.correlation, self.funnel)
        return min(s for s, _ in every), max(e for _, e in every)


def _user_facts(days: DataFrame, spans: Windows, pair: tuple[str, str] | None, steps: Sequence[str],
                window_days: int) -> DataFrame:
    """Rows of ``user_event_days`` with the facts of their user, and of their user and event, on each.

    ``one_user`` / ``one_event`` mark one row of each user / (user, event). All windows lie within
    a user, on the reduced rows, so one shuffle by user serves all of them.
    """
    within = lambda span: F.col("event_date").between(*span)
    period = F.when(within(spans.this), F.lit("this")).when(within(spans.previous), F.lit("last"))
    d = days.where(F.col(USER).isNotNull()).select(
        USER, NAME, "event_date", F.col("day").alias("b"), "first_t", "last_t", period.alias("period"),
        F.when(within(spans.correlation), F.col("first_t")).alias("seen"))
    user, event = Window.partitionBy(USER), Window.partitionBy(USER, NAME)
    p, facts = F.col("period"), {}
    if pair:
        bucket = Window.partitionBy("period", USER, "b")
        a, b = F.col(NAME) == pair[0], F.col(NAME) == pair[1]
        d = d.withColumns({"min_a": F.min(F.when(a, F.col("first_t"))).over(bucket),
                           "max_a": F.max(F.when(a, F.col("last_t"))).over(bucket),
                           "min_b": F.min(F.when(b, F.col("first_t"))).over(bucket),
                           "max_b": F.max(F.when(b, F.col("last_t"))).over(bucket)})
        d = d.withColumn("converts", _user_converted(d, window_days, False))
        for name in ("this", "last"):
            facts[f"{name}_starts"] = F.bool_or((p == name) & F.col("min_a").isNotNull()).over(user)
            facts[f"{name}_finishes"] = F.bool_or((p == name) & F.col("converts")).over(user)
    for i, step in enumerate(steps, 1):
        facts[f"s{i}"] = F.min(F.when((F.col(NAME) == step) & within(spans.funnel), F.col("first_t"))).over(user)
    facts |= {"first_seen": F.min("seen").over(user), "event_seen": F.min("seen").over(event),
              "in_this": F.bool_or(p == "this").over(event), "in_last": F.bool_or(p == "last").over(event),
              "one_event": F.row_number().over(event.orderBy("event_date", "b")) == 1,
              "one_user": F.row_number().over(user.orderBy(NAME, "event_date", "b")) == 1}
    d = d.withColumns(facts)
    back = F.col("seen").isNotNull() & (F.col("b") == F.floor(F.col("first_seen") / MICROS_PER_DAY) + RETURN_DAY)
    return d.withColumns({"back": F.max(back).over(user),
                          "day1": F.col("event_seen") - F.col("first_seen") < (DAY1_HOURS + 1) * MICROS_PER_HOUR})


def _ranked_facts(days: DataFrame, spans: Windows, pair: tuple[str, str] | None, steps: Sequence[str],
                  window_days: int) -> DataFrame:
    """The first rows of every built-in rule's ranked result, told apart by ``rule``; one scan.

    The users' facts are summed per event and over all users in one tagged aggregate; what
    follows has a row per event name.
    """
    rows = _user_facts(days, spans, pair, steps, window_days)
    about = F.array_compact(F.array(
        F.when(F.col("one_event") & F.col(NAME).isNotNull(), F.struct(F.lit(False).alias("all"), F.col(NAME).alias("of"))),
        F.when(F.col("one_user"), F.struct(F.lit(True).alias("all"), F.lit(None).cast("string").alias("of")))))
    counts = [F.count_if("in_this").alias("this_users"), F.count_if("in_last").alias("last_users"),
              F.count_if("day1").alias("did"), F.count_if(F.col("day1") & F.col("back")).alias("did_back"),
              F.count_if(F.col("first_seen").isNotNull()).alias("seen_users"),
              F.count_if(F.col("first_seen").isNotNull() & F.col("back")).alias("seen_back")]
    if pair:
        counts += [F.count_if(c).alias(c) for c in ("this_starts", "this_finishes", "last_starts", "last_finishes")]
    counts += [F.count_if(F.coalesce(step_reached(i, window_days), F.lit(False))).alias(f"step_{i}")
               for i in range(1, len(steps) + 1)]
    sums = (rows.withColumn("about", F.explode(about)).withColumns({"all": F.col("about.all"), "of": F.col("about.of")})
            .groupBy("all", "of").agg(*counts))
    # The row of all users beside every event: one row per event name here.
    beside = Window.partitionBy(F.lit(1))
    total = lambda c: F.max(F.when(F.col("all"), F.col(c))).over(beside)
    sums = sums.withColumns({"users_all": total("seen_users"), "back_all": total("seen_back")})
    did, no = F.col("did"), F.col("users_all") - F.col("did")
    w_r = F.try_divide(F.col("did_back"), did).cast("double")
    wo_r = F.try_divide(F.col("back_all") - F.col("did_back"), no).cast("double")
    new = {NAME: F.col("of"), "did_event_users": did, "no_event_users": no, "d7_retention_with_event": w_r,
           "d7_retention_without_event": wo_r,
           "pct_change": F.try_divide(F.col("this_users") - F.col("last_users"), F.col("last_users")).cast("double")}
    if pair:
        new |= {f"{n}_rate": F.try_divide(F.col(f"{n}_finishes"), F.col(f"{n}_starts")).cast("double") for n in ("this", "last")}
    sums = sums.withColumns(new)

    def place(rule: str, value: Column, step: int = 0) -> Column:
        return F.struct(F.lit(rule).alias("rule"), value.cast("double").alias("value"), F.lit(step).alias("step_index"),
                        F.lit(steps[step - 1] if step else None).cast("string").alias("event"),
                        (F.col(f"step_{step}") if step else F.lit(None)).cast("long").alias("users"))

    every, single = F.col("all"), ~F.col("all")
    places = [F.when(single & (F.col("last_users") >= MIN_USERS), place("volume", F.abs(F.coalesce("pct_change", F.lit(0.0))))),
              F.when(single & (did >= MIN_USERS) & (no >= MIN_USERS), place("retention", w_r - wo_r))]
    if pair:
        places.append(F.when(every, place("conversion", F.lit(0.0))))
    for i in range(2, len(steps) + 1):
        before = F.col(f"step_{i - 1}")
        places.append(F.when(every & (before > 0), place("funnel", F.try_divide(before - F.col(f"step_{i}"), before), i)))
    placed = sums.withColumn("_p", F.explode(F.array_compact(F.array(*places)))).select("*", "_p.*").drop("_p")
    order = Window.partitionBy("rule").orderBy(F.col("value").desc_nulls_last(), "step_index", NAME)
    return (placed.withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= RULE_TOP)
            .withColumn("drop_off_from_prev_pct", F.col("value")))


def _built_in(days: DataFrame, spans: Windows, pair: tuple[str, str] | None, steps: Sequence[str], window_days: int,
              labels: tuple[str, str], gates: dict[str, float]) -> DataFrame:
    """The built-in rules' insights with ``_rule``, their place in the order of rules."""
    says = {"volume": _say_volume(labels[0], gates.get("volume", VOLUME_MIN_REL)),
            "retention": _say_retention(gates.get("lift", RETENTION_MIN_LIFT))}
    if pair:
        says["conversion"] = _say_conversion(*pair, labels[1], gates.get("conversion", CONVERSION_MIN_REL))
    if steps:
        gate, cols = _say_funnel_drop()
        says["funnel"] = gate & (F.col("_rn") == 1), cols
    rows = [F.when((F.col("rule") == rule) & gate,
                   F.struct(*cols, F.col("_rn").cast("int").alias("position"), F.lit(i).alias("_rule")))
            for i, (rule, (gate, cols)) in enumerate(says.items())]
    ranked = _ranked_facts(days, spans, pair, steps, window_days)
    return ranked.select(F.coalesce(*rows).alias("i")).where(F.col("i").isNotNull()).select("i.*")


def _run(events: DataFrame, spans: Windows, funnel_steps: DataFrame | None, pair: tuple[str, str] | None,
         steps: Sequence[str], window_days: int, labels: tuple[str, str], rules: Sequence[Rule],
         gates: dict[str, float]) -> DataFrame:
    days = user_event_days(events, *spans.span())
    found = _built_in(days, spans, pair, check_steps(steps) if steps else (), window_days, labels, gates)
    later = ([rule_funnel_drop(funnel_steps)] if funnel_steps is not None else []) + apply_rules(
        Facts(days, spans.this, spans.previous), rules)
    for i, rows in enumerate(later):
        found = found.unionByName(rows.withColumn("_rule", F.lit(BUILT_IN_RULES + i)))
    return _by_severity(found)


BUILT_IN_RULES = 4


def run_insights(events: DataFrame, start: str, end: str, funnel_steps: DataFrame | None = None,
                 funnel_start_event: str | None = None, funnel_end_event: str | None = None,
                 window_days: int = 7, rules: Sequence[Rule] = (), steps: Sequence[str] = (),
                 funnel_range: tuple[str, str] | None = None) -> DataFrame:
    """F16: all rules for a date range, then the caller's ``rules``, ranked by severity (stable in rule order).

    Volume and conversion compare [start, end] with the equally long period before;
    retention correlation reads [start, end]. ``steps`` is the funnel to look into, over
    ``funnel_range`` ([start, end] if not given). All of them are written over one partial aggregate
    (``user_event_days``) in one chain, so the plan has a single scan. A funnel that the caller has already
    computed may be given as ``funnel_steps`` instead; it and the caller's rules add their own plans.
    """
    ts, te, ps, pe = periods_from_range(start, end)
    spans = Windows((ts, te), (ps, pe), (ts, te), funnel_range or (ts, te))
    return _run(events, spans, funnel_steps, _pair(funnel_start_event, funnel_end_event), steps, window_days,
                ("this period", "vs previous period"), rules, {})


CORRELATION_DAYS = 30     # weekly mode: the correlation reaches this many days before yesterday


def run_insights_weekly(events: DataFrame, as_of: date, funnel_steps: DataFrame | None = None,
                        funnel_start_event: str | None = None, funnel_end_event: str | None = None,
                        window_days: int = 7, rules: Sequence[Rule] = (), steps: Sequence[str] = (),
                        funnel_range: tuple[str, str] | None = None, **gates: float) -> DataFrame:
    """F16 without a date range: the last seven full days before ``as_of`` against the seven before.

    ``gates`` may lower the rules' thresholds: ``volume``, ``lift``, ``conversion``. The rest as in ``run_insights``.
    """
    ts, te, ps, pe = week_windows(as_of)
    spans = Windows((ts, te), (ps, pe), (shift(te, -CORRELATION_DAYS), te), funnel_range or (ts, te))
    return _run(events, spans, funnel_steps, _pair(funnel_start_event, funnel_end_event), steps, window_days,
                ("this week", "vs last week"), rules, gates)


def _pair(start_event: str | None, end_event: str | None) -> tuple[str, str] | None:
    return (start_event, end_event) if start_event and end_event else None


def rank_insights(parts: list[DataFrame]) -> DataFrame:
    """Union rule outputs (in rule order) and rank them by severity, desc.

    Stable in the reference's sense: equal severities keep rule order, then each
    rule's own result order (``position``). The input is a handful of rows.
    """
    tagged = [p.withColumn("_rule", F.lit(i)) for i, p in enumerate(parts)]
    allrows = tagged[0]
    for p in tagged[1:]:
        allrows = allrows.unionByName(p)
    return _by_severity(allrows)


def _by_severity(rows: DataFrame) -> DataFrame:
    order = [F.col("severity").desc(), F.col("_rule").asc(), F.col("position").asc(), F.col("id").asc()]
    return (rows.withColumn("rank", F.row_number().over(Window.orderBy(*order)))
            .select("rank", *INSIGHT_COLUMNS))
