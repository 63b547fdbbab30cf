"""Insight rules, KPI math, investigator helpers (cases from the reference's unit tests)."""
from datetime import date, datetime, timezone

import pytest
from pyspark.sql import functions as F

from evlens.operators import insights as I
from evlens.operators import investigate as V
from evlens.operators import kpis as K
from evlens.operators import retention as R


def steps_df(spark, users):
    rows = []
    for i, u in enumerate(users, 1):
        drop = None if i == 1 else ((users[i - 2] - u) / users[i - 2] if users[i - 2] > 0 else None)
        rows.append((i, f"e{i}", u, drop, u / users[0] if users[0] else 0.0))
    return spark.createDataFrame(rows, "step_index int, event string, users bigint, "
                                       "drop_off_from_prev_pct double, conversion_from_start_pct double")


def test_worst_funnel_step(spark):
    r = I.rule_funnel_drop(steps_df(spark, [1000, 800, 200, 150])).collect()
    assert len(r) == 1 and r[0].id == "funnel_drop_e3" and r[0].severity == pytest.approx(0.75)
    assert r[0].title == 'Biggest drop-off is at "e3" (75.0%)'
    assert r[0].detail.startswith("Only 200 of the previous step's users continued to e3.")


def test_funnel_below_gate(spark):
    assert I.rule_funnel_drop(steps_df(spark, [1000, 900, 850])).count() == 0


def test_first_strict_maximum_wins(spark):
    r = I.rule_funnel_drop(steps_df(spark, [1000, 500, 250])).first()
    assert r.id == "funnel_drop_e2"


def conv(spark, ts, tf, ls, lf):
    return spark.createDataFrame([(ts, tf, tf / ts if ts else None, ls, lf, lf / ls if ls else None)],
                                 "this_starts bigint, this_finishes bigint, this_rate double, "
                                 "last_starts bigint, last_finishes bigint, last_rate double")


def test_conversion_rule(spark):
    r = I.rule_conversion(conv(spark, 100, 30, 100, 40), "signup", "purchase").first()
    assert r.title == "signup → purchase conversion dropped 25.0% vs previous period"
    assert r.detail == "This period: 30.0% (30 of 100 users). Previous: 40.0% (40 of 100)."
    assert r.severity == pytest.approx(0.5) and r.end_event == "purchase"
    assert I.rule_conversion(conv(spark, 100, 41, 100, 40), "a", "b").count() == 0   # < 5 %
    assert I.rule_conversion(conv(spark, 40, 10, 100, 40), "a", "b").count() == 0    # < 50 starts
    assert I.rule_conversion(conv(spark, 100, 10, 100, 0), "a", "b").count() == 0    # last rate 0


def test_volume_rule_limit_then_threshold(spark):
    vol = spark.createDataFrame([("a", 10, 100, -0.9), ("b", 150, 100, 0.5), ("c", 130, 100, 0.3),
                                 ("d", 60, 100, -0.4)],
                                "event_name string, this_users bigint, last_users bigint, pct_change double")
    got = [r.id for r in I.rule_volume(vol).collect()]
    assert sorted(got) == ["vol_a", "vol_b", "vol_d"]       # c (0.3) passes the gate but ranks 4th
    r = {x.id: x for x in I.rule_volume(vol).collect()}
    assert r["vol_a"].title == '"a" dropped 90.0% this period' and r["vol_b"].severity == 0.5


def test_retention_rule(spark):
    corr = spark.createDataFrame(
        [("x", 60, 70, 0.8, 0.5, 0.3), ("y", 60, 70, 0.55, 0.5, 0.05)],
        "event_name string, did_event_users bigint, no_event_users bigint, d7_retention_with_event double, "
        "d7_retention_without_event double, lift double")
    r = I.rule_retention(corr).collect()
    assert [x.id for x in r] == ["ret_corr_x"]
    assert r[0].title == 'Users who do "x" on day 1 retain 30.0pp better at D7'
    assert r[0].severity == pytest.approx(0.6)


def test_ranking_is_stable(spark):
    from evlens.plans import fixture as fx
    from evlens.sources.canonical import canonical_events
    ev = canonical_events(spark, "/root/testdata/sf0.001", fx.START, fx.END)
    steps = steps_df(spark, [1000, 500, 100])
    out = I.run_insights(ev, *fx.HALF_B, funnel_steps=steps).collect()
    sev = [r.severity for r in out]
    assert sev == sorted(sev, reverse=True) and [r.rank for r in out] == list(range(1, len(out) + 1))


def test_retention_headline_weighted(spark):
    rows = spark.createDataFrame([(100, 50, 30, 10), (200, 80, 40, 20)],
                                 "cohort_size bigint, d1_users bigint, d7_users bigint, d30_users bigint")
    h = R.headline(rows).first()
    assert (h.d1_avg, h.d7_avg, h.d30_avg) == pytest.approx((130 / 300, 70 / 300, 30 / 300))
    assert (h.d1_retained, h.total_users) == (130, 300)
    empty = R.headline(rows.limit(0)).first()
    assert (empty.d1_avg, empty.d7_avg, empty.total_users) == (0.0, 0.0, 0)


def kpis_df(spark, cur, prev, cur_d7=0.2, prev_d7=0.25):
    return spark.createDataFrame([("current", cur, cur, cur_d7), ("previous", prev, prev, prev_d7)],
                                 "period string, active_users bigint, total_events bigint, d7_rate double")


@pytest.mark.parametrize("cur,prev,pct,direction", [
    (1080, 1000, 8.0, "up"), (920, 1000, -8.0, "down"), (1002, 1000, 0.2, "flat"),
    (100, 0, None, "up"), (0, 0, 0.0, "flat"), (None, 1000, None, None),
])
def test_kpi_deltas(spark, cur, prev, pct, direction):
    d = {r.kpi: r for r in K.kpi_deltas(kpis_df(spark, cur, prev)).collect()}
    assert d["active_users"].pct == pct and d["active_users"].direction == direction
    if cur is not None and prev is not None:
        assert d["total_events"].absolute == cur - prev


@pytest.mark.parametrize("cur,prev,pp,direction", [
    (0.20, 0.25, -5.0, "down"), (0.259, 0.238, 2.1, "up"), (0.2502, 0.25, 0.0, "flat"),
])
def test_d7_pp(spark, cur, prev, pp, direction):
    d = {r.kpi: r for r in K.kpi_deltas(kpis_df(spark, 1, 1, cur, prev)).collect()}
    assert d["d7_rate"].pp == pp and d["d7_rate"].direction == direction


def test_growth_check(spark):
    import datetime as dt
    days = [(dt.date(2024, 1, i + 1), 100 + (10 if i >= 13 else 0)) for i in range(20)]
    g = K.growth_check(spark.createDataFrame(days, "day date, dau bigint")).first()
    assert g.first_week_avg == 100 and g.last_week_avg == 110 and g.rel_change == pytest.approx(0.1)
    short = K.growth_check(spark.createDataFrame(days[:13], "day date, dau bigint")).first()
    assert short.days == 13 and short.rel_change is None


def test_freshness_status(spark):
    as_of = datetime(2024, 1, 31, tzinfo=timezone.utc)
    base = int(as_of.timestamp()) * 1_000_000
    rows = [(base - h * 3_600_000_000, 3) for h in (1, 40, 100)] + [(None, 0)]
    df = spark.createDataFrame(rows, "latest_event bigint, days_with_data bigint")
    assert [r.status for r in K.freshness_status(df, as_of).collect()] == ["fresh", "stale", "broken", "no_data"]


def axis_rows(spark, rows):
    return spark.createDataFrame(rows, "axis string, value string, users bigint")


def test_concentration_and_shared_denominator(spark):
    from tests.helpers import ev, frame
    rows = [ev(str(i), "purchase", "2024-01-16 00:00:00", country="IN" if i < 3 else "US",
               platform="IOS" if i < 3 else "WEB") for i in range(4)]
    out = V.investigate_where(frame(spark, rows), "purchase", "20240116", "20240116").collect()
    top = {(r.axis, r.rank): r for r in out}
    assert top[("country", 1)].share == 0.75 and top[("country", 1)].concentrated
    assert top[("platform", 1)].share == 0.75 and top[("country", 2)].share == 0.25
    assert all(r.total_affected_users == 4 for r in out)
    assert V.target_event(None, "purchase") == "purchase" and V.target_event() == "session_start"


@pytest.mark.parametrize("before,after,expected", [
    ([], [10, 10], None),                 # no baseline days
    ([0, 0], [1, 2], "2024-01-17"),       # zero baseline counts as 1
    ([100, 100], [125, 80], "2024-01-16"),  # exactly +25 %
    ([100, 100], [124, 76, 75], "2024-01-18"),
])
def test_change_day(spark, before, after, expected):
    import datetime as dt
    rows = [(dt.date(2024, 1, 16) - dt.timedelta(days=len(before) - i), 1, c) for i, c in enumerate(before)]
    rows += [(dt.date(2024, 1, 16) + dt.timedelta(days=i), 1, c) for i, c in enumerate(after)]
    tl = spark.createDataFrame(rows, "date date, dau bigint, target_count bigint")
    got = V.change_day(tl, "20240116", "20240131").first().change_started_on
    assert (got.isoformat() if got else None) == expected


def test_relative_share(spark):
    df = spark.createDataFrame([("a", 50), ("b", 25)], "event_name string, unique_users bigint")
    assert [r.bar_pct for r in K.relative_share(df).orderBy("event_name").collect()] == [100.0, 50.0]


def test_ranking_keeps_rule_order_on_equal_severity(spark):
    vol = spark.createDataFrame([("a", 0, 100, -1.0), ("b", 400, 100, 3.0), ("c", 10, 100, -0.9)],
                                "event_name string, this_users bigint, last_users bigint, pct_change double")
    funnel = I.rule_funnel_drop(steps_df(spark, [1000, 0]))       # severity 1.0 as well
    ranked = I.rank_insights([I.rule_volume(vol), funnel]).orderBy("rank").collect()
    assert [r.id for r in ranked] == ["vol_b", "vol_a", "funnel_drop_e2", "vol_c"]


def test_own_rules_are_ranked_with_the_built_in_ones(spark):
    ev = _two_halves(spark)

    def loud(facts):
        n = facts.days.withColumn("period", facts.period()).groupBy().agg(
            F.sum(F.when(F.col("period") == "this", F.col("n"))).alias("now"), F.sum(F.when(F.col("period") == "previous", F.col("n"))).alias("before"))
        return n.select(*I.insight(F.lit("loud"), "volume", F.lit(0.4), F.lit("t"), F.lit("d"), {"now": F.col("now"), "before": F.col("before")}),
                        F.lit(1).alias("position"), F.lit("x").alias("more"))

    rows = I.run_insights(ev, "20240108", "20240114", rules=[loud, lambda facts: loud(facts).withColumn("severity", F.lit(0.9))]).collect()
    own = [r for r in rows if r["id"] == "loud"]
    assert [r["severity"] for r in own] == [0.9, 0.4] and own[0]["metric"] == {"now": 2.0, "before": 3.0}
    assert [r["rank"] for r in rows] == list(range(1, len(rows) + 1))
    with pytest.raises(ValueError, match="position"):
        I.run_insights(ev, "20240108", "20240114", rules=[lambda facts: loud(facts).drop("position")])
    weekly = I.run_insights_weekly(ev, date(2024, 1, 15), rules=[loud]).collect()
    assert [r["metric"] for r in weekly if r["id"] == "loud"] == [{"now": 2.0, "before": 3.0}]


def _two_halves(spark):
    days = ["20240102", "20240103", "20240107", "20240108", "20240113"]
    rows = [(d, 1_704_067_200_000_000 + (int(d[-2:]) - 1) * 86_400_000_000, f"u{k % 2}", "view") for k, d in enumerate(days)]
    return spark.createDataFrame(rows, "event_date string, event_timestamp long, user_pseudo_id string, event_name string")
