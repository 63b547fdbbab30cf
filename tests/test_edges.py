"""NULL users, NULL event names and empty values."""
from evlens.operators import breakdown as B
from evlens.operators import events as E
from evlens.operators import insights as I
from evlens.operators import investigate as V
from tests.helpers import ev, frame

THIS, LAST = ("20240108", "20240114"), ("20240101", "20240107")


def test_volume_change_excludes_null_names(spark):
    rows = [ev(str(u), None, "2024-01-02 00:00:00") for u in range(3)]
    rows += [ev(str(u), "x", "2024-01-02 00:00:00") for u in range(2)]
    rows += [ev("9", "x", "2024-01-09 00:00:00"), ev(None, "x", "2024-01-09 00:00:00")]
    got = {r.event_name: r for r in I.event_volume_change(frame(spark, rows), THIS, LAST, 0, None).collect()}
    assert set(got) == {"x"}
    assert (got["x"].this_users, got["x"].last_users, got["x"].pct_change) == (1, 2, -0.5)


def test_null_users(spark):
    rows = [ev(None, "x", "2024-01-02 00:00:00"), ev(None, "x", "2024-01-03 00:00:00"),
            ev("a", "x", "2024-01-02 00:00:00")]
    df = frame(spark, rows)
    assert [r.user_pseudo_id for r in E.recent_users(df, "20240101", "20240131").collect()] == ["a"]
    assert {r.day.day: r.dau for r in E.daily_activity(df, "20240101", "20240131").collect()} == {2: 1, 3: 0}
    assert E.active_users(df, "20240101", "20240131").first().active_users == 1
    assert E.total_events(df, "20240101", "20240131").first().total_events == 3
    cohort = [{"field": "platform", "field_type": "column", "operator": "equals", "values": ["WEB"]}]
    assert E.total_events(df, "20240101", "20240131", cohort).first().total_events == 1


def test_empty_and_null_values_are_not_series(spark):
    rows = [ev("a", "x", "2024-01-02 00:00:00", country=""), ev("b", "x", "2024-01-02 00:00:00", country=None),
            ev("c", "x", "2024-01-02 00:00:00", country="FR")]
    df = frame(spark, rows)
    vals = B.breakdown_values(df, "geo.country", None, "20240101", "20240131").collect()
    assert [(r.value, r.users) for r in vals] == [("FR", 1)]
    where = V.investigate_where(df, "x", "20240101", "20240131").where("axis = 'country'").collect()
    assert [(r.value, r.share) for r in where] == [("FR", 1 / 3)]


def test_conversion_ignores_null_users_and_empty_periods(spark):
    rows = [ev(None, "signup", "2024-01-09 00:00:00"), ev(None, "purchase", "2024-01-09 01:00:00")]
    r = I.conversion_change(frame(spark, rows), "signup", "purchase", THIS, LAST).first()
    assert (r.this_starts, r.this_finishes, r.this_rate, r.last_rate) == (0, 0, None, None)


def test_approximate_distinct_users(spark):
    from evlens.plans import fixture as fx
    from evlens.sources.canonical import canonical_events
    ev = canonical_events(spark, "/root/testdata/sf0.1", fx.START, fx.END)
    exact = E.active_users(ev, fx.START, fx.END).first().active_users
    approx = E.active_users(ev, fx.START, fx.END, approx=True).first().active_users
    assert abs(approx - exact) <= 0.04 * exact        # rsd 1 %: 4 standard deviations
    days = {r.day: r.dau for r in E.daily_activity(ev, fx.START, fx.END).collect()}
    adays = {r.day: r.dau for r in E.daily_activity(ev, fx.START, fx.END, approx=True).collect()}
    assert set(days) == set(adays) and all(abs(adays[d] - days[d]) <= 0.04 * days[d] for d in days)


def test_scans_and_writer(spark):
    import os
    import tempfile
    from datetime import date

    from evlens.sources.scan import recent_scan, sample_day
    from evlens.sources.sink import write_result
    df = frame(spark, [ev("a", "x", f"2024-01-{d:02d} 10:00:00") for d in range(1, 31)])
    assert recent_scan(df, date(2024, 1, 31), 3).count() == 3          # 28, 29, 30 (31 has no data)
    assert recent_scan(df, "20240115", 0).count() == 1
    assert sample_day(df, "20240110").count() == 1 and sample_day(df, "20240110", limit=1).count() == 1
    out = os.path.join(tempfile.mkdtemp(prefix="evlens-result-"), "r")
    write_result(E.top_events(df, "20240101", "20240131"), out)
    assert spark.read.parquet(out).first().event_count == 30


def test_explain_context_kinds(spark):
    rows = [ev(str(u), n, f"2024-01-{d:02d} 10:00:00") for u in range(3) for n in ("x", "y") for d in (2, 9)]
    df = frame(spark, rows)
    volume = I.explain_context(df, "20240108", "20240114", kind="volume").collect()
    assert {r.section for r in volume} == {"top_events"}
    conv = I.explain_context(df, "20240108", "20240114", kind="conversion").collect()
    # movers need >= 30 users in the previous period; 3 users give top events only
    assert {r.section for r in conv} == {"top_events"} and len(conv) == 2


def test_maturity(spark):
    from datetime import date

    from evlens.operators import retention as R
    df = frame(spark, [ev("a", "x", "2024-01-25 10:00:00"), ev("b", "x", "2024-01-29 10:00:00")])
    m = R.maturity(R.retention(df, "20240101", "20240131"), date(2024, 1, 31)).first()
    assert (m.days_span, m.d1_ready, m.d7_ready, m.d30_ready) == (6, True, False, False)


def test_literal_frame(spark):
    from evlens.functions.literals import literal_frame
    cols = [("k", "string"), ("n", "bigint")]
    df = literal_frame(spark, cols, [("a", 1), ("b", 2)])
    assert [tuple(r) for r in df.orderBy("k").collect()] == [("a", 1), ("b", 2)]
    assert dict(df.dtypes) == {"k": "string", "n": "bigint"}
    empty = literal_frame(spark, cols, [])
    assert empty.count() == 0 and dict(empty.dtypes) == {"k": "string", "n": "bigint"}
