"""Registered queries: each is ``(spark, sf_dir) -> DataFrame`` over the test warehouse.

Every query reads whole tables for its date window (no id subsets, no row caps
except where a top-k is the feature) and returns the comparison form
(``common.finish``).
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evlens.functions import params as P
from evlens.functions.periods import range_preset
from evlens.operators import funnel as FN
from evlens.plans import fixture as fx
from evlens.plans.common import events, finish
from evlens.schema import NAME, TS, USER
from evlens.sources.scan import scan

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


# ---------------------------------------------------------------- step 1
@register("canonical_events")
def q_canonical_events(spark, sf):
    from evlens.sources.canonical import canonical_events
    ev = canonical_events(spark, sf)
    return finish(ev.select(
        "event_date", TS, NAME, USER, "platform",
        F.col("geo.country").alias("country"), F.col("geo.region").alias("region"),
        F.col("device.category").alias("device_category"), F.col("app_info.version").alias("app_version"),
        P.param_int("k").alias("param_k"),
        P.param_int("engagement_time_msec").alias("engagement_msec"),
        P.param_int("ga_session_id").alias("session_id"),
        P.param_string("screen_name").alias("screen_name"),
        P.user_property("segment").alias("segment")))


@register("event_param_sample")
def q_event_param_sample(spark, sf):
    from evlens.operators.events import event_param_sample
    ev = events(spark, sf, fx.START, fx.END)
    return finish(event_param_sample(ev, "purchase", "k", fx.START, fx.END, limit=100))


# ---------------------------------------------------------------- step 2
@register("funnel")
def q_funnel(spark, sf):
    ev = events(spark, sf, fx.START, fx.END)
    return finish(FN.funnel(ev, fx.FUNNEL_STEPS, fx.START, fx.END, fx.WINDOW_DAYS))


@register("funnel_strict")
def q_funnel_strict(spark, sf):
    ev = events(spark, sf, fx.START, fx.END)
    return finish(FN.funnel(ev, fx.FUNNEL_STEPS, fx.START, fx.END, fx.WINDOW_DAYS, strict=True))


# ---------------------------------------------------------------- step 3: cohort operators
from evlens.functions import cohort as C  # noqa: E402
from evlens.operators import events as E  # noqa: E402


def _f(field, op, values, field_type="column"):
    return {"field": field, "field_type": field_type, "operator": op, "values": values}


COHORTS = {
    "cohort_not_equals": [_f("geo.region", "not_equals", ["ASIA"])],
    "cohort_in": [_f("geo.country", "in", ["NATION_1", "NATION_2", "NATION_3", "NATION_4"])],
    "cohort_not_in": [_f("device.category", "not_in", ["mobile"])],
    "cohort_contains": [_f("geo.country", "contains", ["_1"])],
    "cohort_starts_with": [_f("geo.country", "starts_with", ["NATION_2"])],
    "cohort_user_property": [_f("segment", "equals", ["BUILDING"], "user_property")],
}
FUNNEL_COHORTS = {
    "cohort_equals": [_f("platform", "equals", ["IOS"])],
    # Both filters must hold on the same event row (user-level cohort).
    "cohort_and": [_f("app_info.version", "equals", ["2.0"]),
                   _f("screen_name", "equals", ["purchase"], "event_param")],
    "cohort_event_param": [_f("k", "in", [7, 8, 9, 10, 11], "event_param")],
}
ROW_LEVEL_COHORT = [_f("app_info.version", "starts_with", ["2.1"]), _f("platform", "in", ["IOS", "WEB"])]


def _top_events_cohort(name):
    def run(spark, sf):
        ev = events(spark, sf, fx.START, fx.END)
        return finish(E.top_events(ev, fx.START, fx.END, limit=50, cohort=COHORTS[name]))
    return run


def _funnel_cohort(name):
    def run(spark, sf):
        ev = events(spark, sf, fx.START, fx.END)
        return finish(FN.funnel(ev, fx.FUNNEL_STEPS, fx.START, fx.END, fx.WINDOW_DAYS,
                                cohort=FUNNEL_COHORTS[name]))
    return run


for _name in COHORTS:
    register(_name)(_top_events_cohort(_name))
for _name in FUNNEL_COHORTS:
    register(_name)(_funnel_cohort(_name))


@register("cohort_row_level")
def q_cohort_row_level(spark, sf):
    """Row-level cohort (C10): only matching event rows are counted."""
    window = C.where_cohort(scan(events(spark, sf, fx.START, fx.END), fx.START, fx.END), ROW_LEVEL_COHORT)
    return finish(window.groupBy(NAME).agg(F.count(F.lit(1)).alias("event_count"),
                                           F.count_distinct(USER).alias("unique_users")))


# ---------------------------------------------------------------- step 4: event aggregations
@register("top_events")
def q_top_events(spark, sf):
    return finish(E.top_events(events(spark, sf, fx.START, fx.END), fx.START, fx.END, limit=50))


@register("top_events_last_7")
def q_top_events_last_7(spark, sf):
    """E1 over the preset range of the last seven days before the reference date."""
    start, end = range_preset(7, fx.AS_OF)
    return finish(E.top_events(events(spark, sf, start, end), start, end, limit=50))


@register("top_events_cohort")
def q_top_events_cohort(spark, sf):
    return finish(E.top_events(events(spark, sf, fx.START, fx.END), fx.START, fx.END, limit=50,
                               cohort=[_f("geo.region", "in", ["EUROPE", "AMERICA"])]))


@register("daily_activity")
def q_daily_activity(spark, sf):
    return finish(E.daily_activity(events(spark, sf, fx.START, fx.END), fx.START, fx.END))


@register("active_users")
def q_active_users(spark, sf):
    return finish(E.active_users(events(spark, sf, fx.START, fx.END), fx.START, fx.END))


@register("total_events")
def q_total_events(spark, sf):
    return finish(E.total_events(events(spark, sf, fx.START, fx.END), fx.START, fx.END))


@register("recent_users")
def q_recent_users(spark, sf):
    return finish(E.recent_users(events(spark, sf, fx.START, fx.END), fx.START, fx.END, limit=20))


@register("freshness")
def q_freshness(spark, sf):
    return finish(E.freshness(events(spark, sf), fx.AS_OF, 3))


@register("event_sample")
def q_event_sample(spark, sf):
    """A3: the bottom 500 rows of a day by hash; how they spread over events depends on the rows alone."""
    from evlens.sources.scan import sample_day
    day = sample_day(events(spark, sf, fx.END, fx.END), fx.END, 500)
    return finish(day.groupBy(NAME).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(USER).alias("users")))


@register("field_discovery")
def q_field_discovery(spark, sf):
    return finish(E.field_discovery(events(spark, sf, fx.END, fx.END), fx.END))


# ---------------------------------------------------------------- step 5: retention
from evlens.operators import retention as R  # noqa: E402

RETENTION_COHORT = [_f("platform", "in", ["ANDROID", "WEB"])]


@register("retention")
def q_retention(spark, sf):
    return finish(R.retention(events(spark, sf, fx.START, fx.END), fx.START, fx.END))


@register("retention_cohort")
def q_retention_cohort(spark, sf):
    return finish(R.retention(events(spark, sf, fx.START, fx.END), fx.START, fx.END, cohort=RETENTION_COHORT))


@register("retention_headline")
def q_retention_headline(spark, sf):
    return finish(R.retention_headline(events(spark, sf, fx.START, fx.END), fx.START, fx.END))


@register("retention_maturity")
def q_retention_maturity(spark, sf):
    ev = events(spark, sf, fx.START, fx.END)
    return finish(R.maturity(R.retention(ev, fx.START, fx.END), fx.AS_OF))


# ---------------------------------------------------------------- step 6: suggestions, breakdowns
from evlens.operators import breakdown as B  # noqa: E402


@register("suggest_steps")
def q_suggest_steps(spark, sf):
    ev = events(spark, sf, fx.START, fx.END)
    return finish(FN.suggest_steps(ev, "signup", "purchase", fx.START, fx.END, max_steps=5))


@register("breakdown_values")
def q_breakdown_values(spark, sf):
    ev = events(spark, sf, fx.START, fx.END)
    return finish(B.breakdown_values(ev, "k", "event_param", fx.START, fx.END, top_n=5,
                                     base_cohort=[_f("device.category", "equals", ["desktop"])]))


@register("funnel_breakdown")
def q_funnel_breakdown(spark, sf):
    ev = events(spark, sf, fx.START, fx.END)
    return finish(B.funnel_breakdown(ev, fx.FUNNEL_STEPS, fx.START, fx.END, "k", "event_param",
                                     fx.WINDOW_DAYS, top_n=5))


@register("retention_breakdown")
def q_retention_breakdown(spark, sf):
    ev = events(spark, sf, fx.START, fx.END)
    return finish(B.retention_breakdown(ev, fx.START, fx.END, "geo.region", top_n=5))


@register("compare_cohorts")
def q_compare_cohorts(spark, sf):
    ev = events(spark, sf, fx.START, fx.END)
    return finish(B.compare_cohorts(ev, fx.START, fx.END, "segment", "BUILDING", "MACHINERY"))


# ---------------------------------------------------------------- step 7: period comparisons
from evlens.functions.periods import periods_from_range  # noqa: E402
from evlens.operators import insights as I  # noqa: E402

CONV_PAIR = ("signup", "purchase")
_INSIGHT_SCALARS = ["id", "kind", "severity", "title", "detail", "event", "start_event", "end_event"]


def _conversion(spark, sf, ordered=False):
    ev = events(spark, sf, fx.LAST_WEEK[0], fx.THIS_WEEK[1])
    return I.conversion_change(ev, *CONV_PAIR, fx.THIS_WEEK, fx.LAST_WEEK, fx.WINDOW_DAYS, ordered=ordered)


@register("conversion_change")
def q_conversion_change(spark, sf):
    return finish(_conversion(spark, sf))


@register("conversion_change_ordered")
def q_conversion_change_ordered(spark, sf):
    return finish(_conversion(spark, sf, ordered=True))


def _correlation(spark, sf):
    return I.retention_correlation(events(spark, sf, fx.START, fx.END), fx.START, fx.END, min_users=50)


@register("retention_correlation")
def q_retention_correlation(spark, sf):
    return finish(_correlation(spark, sf))


def _volume(spark, sf):
    ev = events(spark, sf, fx.LAST_WEEK[0], fx.THIS_WEEK[1])
    return I.event_volume_change(ev, fx.THIS_WEEK, fx.LAST_WEEK, min_users=50)


@register("event_volume_change")
def q_event_volume_change(spark, sf):
    return finish(_volume(spark, sf))


@register("adjacent_movers")
def q_adjacent_movers(spark, sf):
    return finish(I.adjacent_movers(events(spark, sf, fx.START, fx.END), *fx.HALF_B))


@register("explain_context")
def q_explain_context(spark, sf):
    return finish(I.explain_context(events(spark, sf, fx.START, fx.END), *fx.HALF_B, kind="conversion"))


# ---------------------------------------------------------------- step 8: insight rules
@register("insight_conversion")
def q_insight_conversion(spark, sf):
    ts, te, ps, pe = periods_from_range(*fx.HALF_B)
    conv = I.conversion_change(events(spark, sf, ps, te), *CONV_PAIR, (ts, te), (ps, pe), fx.WINDOW_DAYS)
    return finish(I.rule_conversion(conv, *CONV_PAIR).select(*_INSIGHT_SCALARS))


@register("insight_funnel_drop")
def q_insight_funnel_drop(spark, sf):
    ev = events(spark, sf, fx.START, fx.END)
    steps = FN.funnel(ev, fx.FUNNEL_STEPS, fx.START, fx.END, fx.WINDOW_DAYS)
    return finish(I.rule_funnel_drop(steps).select(*_INSIGHT_SCALARS))


@register("insight_retention")
def q_insight_retention(spark, sf):
    return finish(I.rule_retention(_correlation(spark, sf)).select(*_INSIGHT_SCALARS))


@register("insight_volume")
def q_insight_volume(spark, sf):
    return finish(I.rule_volume(_volume(spark, sf)).select(*_INSIGHT_SCALARS))


def _with_metric(insight, *names):
    return finish(insight.select(*_INSIGHT_SCALARS, *[F.col("metric")[n].alias(f"metric_{n}") for n in names]))


@register("insight_conversion_any")
def q_insight_conversion_any(spark, sf):
    """F12 with its gates at zero, so that the test data gives a row; metrics spelled out."""
    ev = events(spark, sf, fx.START, fx.END)
    conv = I.conversion_change(ev, *CONV_PAIR, fx.THIS_WEEK, fx.LAST_WEEK, fx.WINDOW_DAYS)
    return _with_metric(I.rule_conversion(conv, *CONV_PAIR, min_rel=0.0, min_starts=0),
                        "this_rate", "last_rate", "rel_change", "this_starts", "this_finishes")


@register("insight_retention_any")
def q_insight_retention_any(spark, sf):
    """F14 without a least lift."""
    return _with_metric(I.rule_retention(_correlation(spark, sf), min_lift=-1.0), "d7_with", "d7_without", "lift")


@register("insight_volume_any")
def q_insight_volume_any(spark, sf):
    """F15 without a least move."""
    return _with_metric(I.rule_volume(_volume(spark, sf), min_rel=0.0), "this", "last", "rel_change")


@register("insights_weekly")
def q_insights_weekly(spark, sf):
    """F16 without a date range: the last full week against the week before, all rules with their gates at zero."""
    ev = events(spark, sf, fx.START, fx.END)
    ranked = I.run_insights_weekly(ev, fx.AS_OF, None, *CONV_PAIR, fx.WINDOW_DAYS, steps=fx.FUNNEL_STEPS,
                                   funnel_range=(fx.START, fx.END), volume=0.0, lift=-1.0, conversion=0.0)
    return finish(ranked.select("rank", *_INSIGHT_SCALARS))


@register("insights_ranked")
def q_insights_ranked(spark, sf):
    ev = events(spark, sf, fx.START, fx.END)
    ranked = I.run_insights(ev, *fx.HALF_B, funnel_start_event=CONV_PAIR[0], funnel_end_event=CONV_PAIR[1],
                            window_days=fx.WINDOW_DAYS, steps=fx.FUNNEL_STEPS, funnel_range=(fx.START, fx.END))
    return finish(ranked.select("rank", *_INSIGHT_SCALARS))


def lapsed_users(facts):
    """A caller's rule: the share of the earlier period's users who were not seen again."""
    users = (facts.days.where(F.col("user_pseudo_id").isNotNull()).withColumn("period", facts.period())
             .groupBy("user_pseudo_id").agg(F.max(F.col("period") == "previous").alias("before"), F.max(F.col("period") == "this").alias("now")))
    n = users.where("before").agg(F.count(F.lit(1)).alias("users"), F.count_if(~F.col("now")).alias("gone")).where("users > 0")
    share = F.col("gone") / F.col("users")
    return n.select(*I.insight(F.lit("lapsed_users"), "volume", share, F.concat(I.pct_text(share), F.lit(" of users did not return")),
                               F.concat(F.col("gone").cast("string"), F.lit(" of "), F.col("users").cast("string"), F.lit(" users.")),
                               {"gone": F.col("gone"), "users": F.col("users")}), F.lit(1).alias("position"))


def quiet_events(facts):
    """A caller's rule with several rows: every event that happened less often than in the period before."""
    per = facts.days.where(F.col("event_name").isNotNull()).withColumn("period", facts.period())
    n = per.groupBy("event_name").agg(F.sum(F.when(F.col("period") == "previous", F.col("n")).otherwise(0)).alias("previous"),
                                      F.sum(F.when(F.col("period") == "this", F.col("n")).otherwise(0)).alias("this")).where("this < previous")
    fall = (F.col("previous") - F.col("this")) / F.col("previous")
    # One row per event name: a handful.
    place = F.row_number().over(Window.orderBy(fall.desc(), "event_name"))
    return n.select(*I.insight(F.concat(F.lit("quiet_"), F.col("event_name")), "volume", fall,
                               F.concat(F.lit('Less of "'), F.col("event_name"), F.lit('"')),
                               F.concat(F.col("this").cast("string"), F.lit(" after "), F.col("previous").cast("string"), F.lit(".")),
                               {"this": F.col("this"), "previous": F.col("previous")}, event=F.col("event_name")),
                    place.alias("position"))


@register("insights_own_rules")
def q_insights_own_rules(spark, sf):
    """2.12: the built-in rules and two of a caller's, ranked together."""
    ev = events(spark, sf, fx.START, fx.END)
    ranked = I.run_insights(ev, *fx.HALF_B, funnel_start_event=CONV_PAIR[0], funnel_end_event=CONV_PAIR[1],
                            rules=[lapsed_users, quiet_events])
    return finish(ranked.select("rank", *_INSIGHT_SCALARS))


# ---------------------------------------------------------------- step 9: investigation
from datetime import date, datetime, timezone  # noqa: E402

from evlens.operators import investigate as V  # noqa: E402
from evlens.operators import kpis as K  # noqa: E402

INVESTIGATE_COHORT = [_f("device.category", "equals", ["desktop"])]


@register("investigate_where")
def q_investigate_where(spark, sf):
    ev = events(spark, sf, *fx.HALF_B)
    return finish(V.investigate_where(ev, "purchase", *fx.HALF_B, base_cohort=INVESTIGATE_COHORT))


def _timeline(spark, sf):
    ev = events(spark, sf, fx.START, fx.END)
    return V.investigate_when(ev, "purchase", *fx.HALF_B, base_cohort=INVESTIGATE_COHORT)


@register("investigate_when")
def q_investigate_when(spark, sf):
    return finish(_timeline(spark, sf))


@register("investigate_insights")
def q_investigate_insights(spark, sf):
    """WHERE and WHEN for every fired insight: the volume moves and the conversion change of the second half."""
    ev = events(spark, sf, *(fx.HALF_A[0], fx.HALF_B[1]))
    fired = I.rule_volume(I.event_volume_change(ev, fx.HALF_B, fx.HALF_A), min_rel=0.0).unionByName(
        I.rule_conversion(I.conversion_change(ev, *CONV_PAIR, fx.HALF_B, fx.HALF_A), *CONV_PAIR, min_rel=0.0))
    return finish(V.investigate_insights(ev, fired, *fx.HALF_B, base_cohort=INVESTIGATE_COHORT))


@register("investigate_change_day")
def q_investigate_change_day(spark, sf):
    return finish(V.change_day(_timeline(spark, sf), *fx.HALF_B))


# ---------------------------------------------------------------- step 10: dashboard
@register("dashboard_kpis")
def q_dashboard_kpis(spark, sf):
    ev = events(spark, sf, fx.START, fx.END)
    return finish(K.dashboard_kpis(ev, *fx.HALF_B, cohort=[_f("platform", "in", ["IOS", "ANDROID"])]))


@register("kpi_deltas")
def q_kpi_deltas(spark, sf):
    ev = events(spark, sf, fx.START, fx.END)
    return finish(K.kpi_deltas(K.dashboard_kpis(ev, *fx.HALF_B)))


@register("growth_check")
def q_growth_check(spark, sf):
    ev = events(spark, sf, fx.START, fx.END)
    return finish(K.growth_check(E.daily_activity(ev, fx.START, fx.END)))


@register("freshness_status")
def q_freshness_status(spark, sf):
    as_of = datetime(fx.AS_OF.year, fx.AS_OF.month, fx.AS_OF.day, tzinfo=timezone.utc)
    return finish(K.freshness_status(E.freshness(events(spark, sf), fx.AS_OF, 3), as_of))


@register("relative_share")
def q_relative_share(spark, sf):
    ev = events(spark, sf, fx.START, fx.END)
    return finish(K.relative_share(E.top_events(ev, fx.START, fx.END, limit=50)))


# ---------------------------------------------------------------- step 11: users
from evlens.operators import users as U  # noqa: E402

@register("user_journey")
def q_user_journey(spark, sf):
    """B5 for every user: all events in time order."""
    ev = events(spark, sf, fx.START, fx.END)
    return finish(U.journeys(ev, fx.START, fx.END))


@register("journey_sample")
def q_journey_sample(spark, sf):
    ev = events(spark, sf, fx.START, fx.END)
    return finish(U.journeys(ev, fx.START, fx.END, first=U.NARRATIVE_HEAD, last=U.NARRATIVE_TAIL))


@register("user_totals")
def q_user_totals(spark, sf):
    return finish(U.user_totals(events(spark, sf, fx.START, fx.END), fx.START, fx.END))


@register("user_top_events")
def q_user_top_events(spark, sf):
    return finish(U.user_top_events(events(spark, sf, fx.START, fx.END), fx.START, fx.END))


def _metrics(spark, sf):
    return U.user_metrics(events(spark, sf, fx.START, fx.END), fx.START, fx.END)


@register("user_metrics")
def q_user_metrics(spark, sf):
    m = _metrics(spark, sf)
    return finish(m.select(
        *[c for c in m.columns if c not in ("top_events", "platforms")],
        F.array_join(F.transform("top_events", lambda t: F.concat_ws(":", t["event"], t["count"].cast("string"))),
                     "|").alias("top_events"),
        F.array_join("platforms", ",").alias("platforms")))


@register("user_patterns")
def q_user_patterns(spark, sf):
    return finish(U.classify(_metrics(spark, sf), fx.AS_OF)
                  .select(USER, "label", "confidence", "description"))


@register("user_narrative")
def q_user_narrative(spark, sf):
    return finish(U.narrative(U.classify(_metrics(spark, sf), fx.AS_OF)))


# Three trailing windows in which every label but no_data occurs (users have about two events a day).
TRAILING_END, TRAILING_DAYS, TRAILING_AS_OF = "20240125", (1, 3, 10), date(2024, 1, 30)


@register("user_narrative_trailing")
def q_user_narrative_trailing(spark, sf):
    ev = events(spark, sf, fx.START, TRAILING_END)
    return finish(U.trailing_narratives(ev, TRAILING_END, TRAILING_DAYS, TRAILING_AS_OF))


@register("user_focus")
def q_user_focus(spark, sf):
    return finish(U.focus_mix(U.user_top_events(events(spark, sf, fx.START, fx.END), fx.START, fx.END, k=None)))


# ---------------------------------------------------------------- step 12: intents
from evlens.operators import intents as T  # noqa: E402


@register("intent_tags")
def q_intent_tags(spark, sf):
    conv = spark.read.parquet(f"{sf}/conversations.parquet")
    return finish(T.tag_intents(conv.where(F.col("role") == "user")).select("conv_id", "turn", "intent"))


# Phrases of the test conversations (invented prose of several languages), of different lengths and
# with common beginnings, so that the longest one, the listed order and the hints all decide rows.
OWN_PHRASES = {
    "english": [" the ", " of ", " of the ", " and ", "tion is ", "this"],
    "german": [" der ", " die ", " und ", " ein", "eine "],
    "spanish": [" la ", " que ", "ción", " en ", " en la"],
    "french": [" le ", " les ", " est ", " en l"],
}
OWN_HINTS = ["was.", "thou", " en la "]


@register("phrase_tags")
def q_phrase_tags(spark, sf):
    """F32 with a caller's phrases, over every turn of the conversations."""
    conv = spark.read.parquet(f"{sf}/conversations.parquet")
    return finish(T.tag_intents(conv, phrases=OWN_PHRASES, off_topic=OWN_HINTS).select("conv_id", "turn", "role", "intent"))


# ---------------------------------------------------------------- step 13: streaming
@register("daily_activity_watermark")
def q_daily_activity_watermark(spark, sf):
    from evlens.streaming.daily_active import flat_event_stream
    from evlens.streaming.watermarked import run_available_now
    stream = flat_event_stream(spark, sf).where(F.col("event_date").between(fx.START, fx.END))
    return finish(run_available_now(stream).orderBy("day"))


@register("daily_activity_stream")
def q_daily_activity_stream(spark, sf):
    from evlens.streaming.daily_active import flat_event_stream, run_available_now
    stream = flat_event_stream(spark, sf).where(F.col("event_date").between(fx.START, fx.END))
    return finish(run_available_now(stream).orderBy("day"))


@register("affected_users")
def q_affected_users(spark, sf):
    """Distinct users of the investigated event (denominator of the axis shares)."""
    ev = events(spark, sf, *fx.HALF_B)
    return finish(V.affected_users(ev, "purchase", *fx.HALF_B, base_cohort=INVESTIGATE_COHORT))


@register("dashboard_overview")
def q_dashboard_overview(spark, sf):
    """KPIs, top 5 events and the DAU series of one window, as one row."""
    ev = events(spark, sf, fx.START, fx.END)      # the period before is read too
    d = K.dashboard_overview(ev, *fx.HALF_B)
    return finish(d.select(
        *[c for c in d.columns if c not in ("top_events", "sparkline")],
        F.array_join(F.transform("top_events", lambda t: F.concat_ws(
            ":", t["event_name"], t["event_count"].cast("string"), t["unique_users"].cast("string"))), "|")
        .alias("top_events"),
        F.array_join(F.transform("sparkline", lambda p: F.concat_ws(
            ":", F.date_format(p["day"], "yyyy-MM-dd"), p["value"].cast("string"))), "|").alias("sparkline")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)
