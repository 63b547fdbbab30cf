"""Operators that reduce the window once: scans in their plans, and results against plain computation."""
import random
from collections import defaultdict
from datetime import date

import pytest
from pyspark.sql import functions as F

from evlens.operators import breakdown as B
from evlens.operators import events as E
from evlens.operators import funnel as FN
from evlens.operators import insights as I
from evlens.operators import investigate as V
from evlens.operators import kpis as K
from evlens.operators import retention as R
from evlens.plans import fixture as fx
from evlens.sources.canonical import canonical_events
from evlens.sources.scan import sample_day
from tests.helpers import D, H, M, ev, frame, shard, us
from tests.test_plans import SF, plan_text

T0 = us("2024-01-10 00:00:00")


def scans(df, table="events"):
    return sum(f"{table}.parquet" in line for line in plan_text(df).splitlines() if "Location" in line)


@pytest.mark.parametrize("build", [
    lambda e: B.funnel_breakdown(e, fx.FUNNEL_STEPS, fx.START, fx.END, "k", "event_param"),
    lambda e: B.retention_breakdown(e, fx.START, fx.END, "geo.region"),
    lambda e: B.compare_cohorts(e, fx.START, fx.END, "platform", "IOS", "WEB")])
def test_breakdowns_read_the_window_once(spark, build):
    assert scans(build(canonical_events(spark, SF, fx.START, fx.END))) == 1


def test_breakdown_tells_base_cohort_and_value_on_one_row(spark):
    rows = [ev("a", "s", T0, platform="IOS", country="DE"), ev("a", "t", T0 + H, platform="WEB", country="FR"),
            ev("b", "s", T0, platform="WEB", country="DE"), ev("b", "t", T0 + H, platform="IOS", country=""),
            ev("c", "s", T0, platform="IOS", country="FR"), ev(None, "s", T0, platform="IOS", country="DE")]
    base = [{"field": "platform", "field_type": "column", "operator": "equals", "values": ["IOS"]}]
    got = {(r.series_label, r.event): (r.series_users, r.users)
           for r in B.funnel_breakdown(frame(spark, rows), ["s", "t"], "20240101", "20240131", "geo.country", base_cohort=base).collect()}
    # a counts for DE (its steps count whatever their country), c for FR; b has no row that is both.
    assert got == {("DE", "s"): (1, 1), ("DE", "t"): (1, 1), ("FR", "s"): (1, 1), ("FR", "t"): (1, 0)}


def test_compared_value_without_rows(spark):
    rows = [ev("a", "s", T0, platform="IOS"), ev("a", "s", T0 + D, platform="IOS")]
    got = {r.series_label: (r.series_users, r.d1_rate, r.total_users)
           for r in B.compare_cohorts(frame(spark, rows), "20240101", "20240131", "platform", "IOS", "WEB").collect()}
    assert got == {"IOS": (1, 1.0, 1), "WEB": (0, 0.0, 0)}


@pytest.mark.parametrize("seed", range(4))
def test_steps_between_at_boundary_micros(spark, seed):
    """Bounds within an hour, on its edges and hours apart; events within a micro of every edge."""
    rng = random.Random(seed)
    rows, want = [], defaultdict(set)
    for u in range(60):
        start = T0 + rng.choice([0, 1, H - 1, H, 30 * M, 5 * H + 7])
        end = start + rng.choice([0, 1, 2, 3, 10 * M, H - 1, H, H + 1, 2 * H, 3 * H + 5, D])
        mine = [("signup", start), ("purchase", end)]
        for e in "vwxyz":
            for _ in range(rng.randint(0, 3)):
                edge = rng.choice([start, end, start // H * H + H, end // H * H, (start + end) // 2])
                mine.append((e, edge + rng.choice([-1, 0, 1])))
        mine += [("signup", start + rng.randint(0, D)), ("purchase", end + rng.randint(0, D))]
        for e, t in mine:
            rows.append(ev(f"u{u}", e, t))
            if e in "vwxyz" and start < t < end:
                want[e].add(u)
    ranked = sorted(want, key=lambda e: (-len(want[e]), e))[:3]
    df = frame(spark, rows).repartition(3)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = FN.suggest_steps(df, "signup", "purchase", "20240101", "20240131", 3).orderBy("position").collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert [r.event_name for r in got] == ["signup", *ranked, "purchase"]


def insight_rows(spark, rows):
    return spark.createDataFrame(rows, "id string, event string, end_event string")


def random_events(seed):
    rng = random.Random(seed)
    return [ev(rng.choice([None, *"abcdefgh"]), rng.choice(["x", "y", "z", "session_start"]), T0 + rng.randint(-9 * D, 9 * D),
               country=rng.choice(["DE", "FR", "", None, "US", "IT", "ES", "NO", "SE"]), platform=rng.choice(["IOS", "WEB"])) for _ in range(500)]


@pytest.mark.parametrize("seed", [1, 2])
def test_insights_are_investigated_as_one_by_one(spark, seed):
    df = frame(spark, random_events(seed))
    asked = [("i1", "x", None), ("i2", None, "y"), ("i3", "x", "z"), ("i4", None, None), ("i5", "absent", None)]
    start, end = "20240110", "20240118"
    got = V.investigate_insights(df, insight_rows(spark, asked), start, end).collect()
    for name, event, last in asked:
        target = V.target_event(event, last)
        where = V.investigate_where(df, target, start, end).collect()
        mine = [r for r in got if r.insight_id == name]
        assert {(r.axis, r["rank"], r.value, r.users, r.share, r.concentrated, r.total_affected_users) for r in mine if r.section == "where"} == {
            (r.axis, r["rank"], r.value, r.users, r.share, r.concentrated, r.total_affected_users) for r in where}
        one = V.change_day(V.investigate_when(df, target, start, end), start, end).first()
        when = [(r.baseline, r.change_started_on) for r in mine if r.section == "when"]
        assert when == [(one.baseline, one.change_started_on)]
        assert {r.target for r in mine} == {target}


def test_insights_without_rows(spark):
    df = frame(spark, random_events(3))
    assert V.investigate_insights(df, insight_rows(spark, []), "20240110", "20240118").collect() == []
    empty = frame(spark, [])
    assert V.investigate_insights(empty, insight_rows(spark, [("i", "x", None)]), "20240110", "20240118").collect() == []


def test_insights_cost_one_scan_and_a_narrow_one(spark):
    events = canonical_events(spark, SF, fx.START, fx.END)
    fired = insight_rows(spark, [("i1", "purchase", None), ("i2", "view", None), ("i3", "click", None)])
    assert scans(V.investigate_insights(events, fired, *fx.HALF_B)) == 2


def test_sample_is_the_same_under_any_partitioning(spark):
    rows = [ev(f"u{i % 40}", f"e{i % 7}", T0 + i * M // 3, params={"k": i}) for i in range(900)] + [ev("u1", "e1", T0)] * 5
    df = frame(spark, rows)
    key = lambda d: sorted((r.user_pseudo_id, r.event_name, r.event_timestamp, str(r.event_params)) for r in d.collect())
    one = key(sample_day(df.coalesce(1), "20240110", 50))
    assert len(one) == 50 and one == key(sample_day(df.repartition(7), "20240110", 50))
    assert one == key(sample_day(df.orderBy(F.desc("event_timestamp")), "20240110", 50))
    assert sample_day(df, "20240110", 10_000).count() == df.count() and sample_day(df, "20240110", 0).count() == 0
    plan = plan_text(sample_day(canonical_events(spark, SF), fx.END, 50))
    assert "TakeOrderedAndProject" in plan


@pytest.mark.parametrize("build", [
    lambda e: K.dashboard_overview(e, *fx.HALF_B),
    lambda e: K.dashboard_overview(e, *fx.HALF_B, cohort=[{"field": "platform", "field_type": "column", "operator": "equals", "values": ["IOS"]}]),
    lambda e: K.dashboard_kpis(e, *fx.HALF_B),
    lambda e: I.run_insights(e, *fx.HALF_B, funnel_start_event="signup", funnel_end_event="purchase", steps=fx.FUNNEL_STEPS),
    lambda e: I.run_insights_weekly(e, fx.AS_OF, None, "signup", "purchase", steps=fx.FUNNEL_STEPS, volume=0.0)])
def test_dashboard_and_insights_read_the_window_once(spark, build):
    assert scans(build(canonical_events(spark, SF, fx.START, fx.END))) == 1


def busy_users(seed, n=160):
    """Users with steps near one another, some without a user or event name, some on a shard day that is not their UTC day."""
    rng = random.Random(seed)
    rows = []
    for u in range(n):
        t = T0 + rng.randint(-9 * D, 8 * D)
        for _ in range(rng.randint(1, 9)):
            name = rng.choice(["x", "x", "y", "z", "w", None] if t < T0 else ["x", "y", "y", "z", None])
            rows.append(ev(f"u{u}" if u % 23 else None, name, t, platform=rng.choice(["IOS", "WEB"]),
                           date=shard(t + D) if rng.random() < 0.1 else None))
            t += rng.choice([1, H, D - 1, D, D + 1, 25 * H, 7 * D])
    return rows


@pytest.mark.parametrize("seed", [4, 5, 6])
def test_insights_of_one_scan_are_those_of_the_single_operators(spark, seed, monkeypatch):
    monkeypatch.setattr(I, "MIN_USERS", 2)
    df = frame(spark, busy_users(seed)).repartition(3)
    as_of, steps = date(2024, 1, 17), ["x", "y", "z", "absent"]
    this, last, corr, whole = ("20240110", "20240116"), ("20240103", "20240109"), ("20231217", "20240116"), ("20240101", "20240130")
    apart = I.rank_insights([
        I.rule_volume(I.event_volume_change(df, this, last, 2), "this week", 0.0),
        I.rule_retention(I.retention_correlation(df, *corr, 2), -1.0),
        I.rule_conversion(I.conversion_change(df, "x", "y", this, last, 3), "x", "y", "vs last week", 0.0),
        I.rule_funnel_drop(FN.funnel(df, steps, *whole, 3))])
    got = I.run_insights_weekly(df, as_of, None, "x", "y", 3, steps=steps, funnel_range=whole, volume=0.0, lift=-1.0, conversion=0.0)
    rows = lambda d: [r.asDict(recursive=True) for r in d.orderBy("rank").collect()]
    one = rows(got)
    assert one == rows(apart) and {r["kind"] for r in one} >= {"volume", "retention", "funnel"}


def test_insights_of_no_rows(spark):
    assert I.run_insights(frame(spark, []), "20240110", "20240116", None, "x", "y", steps=["x", "y"]).collect() == []
    nobody = frame(spark, [ev(None, "x", T0), ev(None, "y", T0 + H)])
    assert I.run_insights(nobody, "20240110", "20240116", None, "x", "y", steps=["x", "y"]).collect() == []


@pytest.mark.parametrize("cohort", [None, [{"field": "platform", "field_type": "column", "operator": "equals", "values": ["IOS"]}]])
def test_dashboard_of_one_scan_is_that_of_the_single_operators(spark, cohort):
    df = frame(spark, busy_users(7)).repartition(3)
    start, end = "20240110", "20240116"
    got = K.dashboard_overview(df, start, end, cohort, top_n=3).first()
    for prefix, s, e in (("", start, end), ("prev_", "20240103", "20240109")):
        head = R.retention_headline(df, s, e, cohort).first()
        assert (got[f"{prefix}period_start"], got[f"{prefix}period_end"]) == (s, e)
        assert got[f"{prefix}active_users"] == E.active_users(df, s, e, cohort).first()[0]
        assert got[f"{prefix}total_events"] == E.total_events(df, s, e, cohort).first()[0]
        assert got[f"{prefix}d7_rate"] == pytest.approx(head.d7_avg)
    assert (got.d7_retained, got.total_cohorted) == (R.retention_headline(df, start, end, cohort).first()["d7_retained"], got.active_users)
    assert [tuple(t) for t in got.top_events] == [tuple(t) for t in E.top_events(df, start, end, 3, cohort).collect()]
    assert [tuple(t) for t in got.sparkline] == [tuple(t) for t in E.daily_activity(df, start, end, cohort).collect()]
    kpis = {r.period: r for r in K.dashboard_kpis(df, start, end, cohort).collect()}
    assert (kpis["current"].total_events, kpis["previous"].d7_rate) == (got.total_events, got.prev_d7_rate)


def test_dashboard_of_no_rows(spark):
    got = K.dashboard_overview(frame(spark, []), "20240110", "20240116").first()
    assert (got.active_users, got.total_events, got.d7_rate, got.top_events, got.sparkline) == (0, 0, 0.0, [], [])
    assert (got.active_users_pct, got.active_users_direction, got.prev_active_users) == (0.0, "flat", 0)
    alone = K.dashboard_overview(frame(spark, []), "20240110", "20240116", compare=False)
    assert "prev_active_users" not in alone.columns and alone.first().total_cohorted == 0
