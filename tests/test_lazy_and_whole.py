"""Queries are lazy and lose nothing: streams in any order, whole journeys, guarded shares, limits of zero."""
import datetime as dt
import os
import tempfile

import pyarrow as pa
import pyarrow.parquet as pq

from evlens.functions.periods import range_preset, week_windows
from evlens.operators import breakdown as B
from evlens.operators import events as E
from evlens.operators import kpis as K
from evlens.operators import users as U
from evlens.sources.canonical import canonicalize, raw_events, user_dimension
from evlens.streaming.daily_active import daily_active, drain, flat_event_stream, run_available_now
from tests.helpers import ev, frame

SF = "/root/testdata/sf0.001"


def write_days(folder, days):
    """One file per day; the earliest day is written last, so a stream reads the days newest first."""
    for i, day in enumerate(sorted(days, reverse=True)):
        rows = [(100 * day + u, dt.datetime(2024, 1, day, 1 + u % 20), None if day == 2 else u % (day + 2), "view", 1.0, '{"k": 1}')
                for u in range(30)]
        cols = list(zip(*rows))
        path = os.path.join(folder, "events.parquet" if i == 0 else f"events_{i}.parquet")
        pq.write_table(pa.table({"event_id": pa.array(cols[0], pa.int64()), "ts": pa.array(cols[1], pa.timestamp("us")),
                                 "user_id": pa.array(cols[2], pa.int64()), "event_type": pa.array(cols[3]),
                                 "value": pa.array(cols[4]), "props": pa.array(cols[5])}), path)
        os.utime(path, (1_700_000_000 + i, 1_700_000_000 + i))
    for t in ("customer", "nation", "region"):
        pq.write_table(pq.read_table(f"{SF}/{t}.parquet"), os.path.join(folder, f"{t}.parquet"))


def test_stream_of_days_newest_first(spark):
    folder = tempfile.mkdtemp(prefix="evlens-days-")
    write_days(folder, range(1, 9))
    got = run_available_now(flat_event_stream(spark, folder, max_files_per_trigger=1))
    flat = spark.read.parquet(*[os.path.join(folder, n) for n in os.listdir(folder) if n.startswith("events")])
    want = E.daily_activity(canonicalize(flat, user_dimension(spark, folder)), "20240101", "20240131")
    assert len(want.collect()) == 8
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_stream_goes_on_where_it_ended(spark):
    folder = tempfile.mkdtemp(prefix="evlens-days-")
    write_days(folder, [5, 6])
    name = os.path.basename(tempfile.mktemp(prefix="evlens-resumed-"))
    first = daily_active(spark, drain(flat_event_stream(spark, folder), name)).count()
    other = tempfile.mkdtemp(prefix="evlens-days-")
    write_days(other, [1])       # a late day
    os.rename(os.path.join(other, "events.parquet"), os.path.join(folder, "events_late.parquet"))
    again = {r["day"].day for r in daily_active(spark, drain(flat_event_stream(spark, folder), name)).collect()}
    assert first == 2 and again == {1, 5, 6}


def test_building_a_query_runs_no_write_and_no_count(spark, monkeypatch):
    from pyspark.sql import DataFrame

    from evlens.plans import catalog

    def refuse(*_, **__):
        raise AssertionError("a job ran while a query was built")

    for action in ("count", "collect", "first", "toPandas"):
        monkeypatch.setattr(DataFrame, action, refuse)
    monkeypatch.setattr(DataFrame, "write", property(refuse))
    for name, build in catalog.queries().items():
        if name not in ("daily_activity_stream", "daily_activity_watermark"):       # draining a stream is their job
            build(spark, SF)


def test_no_join_is_forced_to_broadcast(spark):
    plan = user_dimension(spark, SF)._jdf.queryExecution().analyzed().toString()
    assert "ResolvedHint" not in plan and raw_events(spark, SF).count() > 0


def test_whole_journey_of_a_hot_user(spark):
    rows = [ev("hot", f"e{k % 3}", 1_704_067_200_000_000 + 60_000_000 * (k // 2), params={"ga_session_id": k}) for k in range(700)]
    rows += [ev("b", "x", "2024-01-01 05:00:00")]
    got = U.journeys(frame(spark, rows).repartition(5), "20240101", "20240102").collect()
    hot = sorted((r for r in got if r["user_pseudo_id"] == "hot"), key=lambda r: r["seq"])
    assert [r["seq"] for r in hot] == list(range(1, 701))
    key = [(r["event_time"], r["event_name"], r["session_id"]) for r in hot]
    assert key == sorted(key)
    one = U.user_journey(frame(spark, rows), "hot", "20240101", "20240102").collect()
    assert [(r["event_time"], r["event_name"], r["session_id"]) for r in one] == key


def test_focus_looks_at_all_events(spark):
    rows = [ev("a", f"purchase_{k}", "2024-01-01 00:00:00") for k in range(8) for _ in range(3)]
    rows += [ev("a", f"share_{k}", "2024-01-01 00:00:00") for k in range(24)]
    mix = {r["label"]: r["pct"] for r in U.focus_mix(U.user_top_events(frame(spark, rows), "20240101", "20240101", k=None)).collect()}
    assert mix["Monetization"] == 50 and mix["Social"] == 50


def test_share_of_nothing(spark):
    rows = frame(spark, [ev(None, "x", "2024-01-01 00:00:00")])
    got = K.relative_share(E.top_events(rows, "20240101", "20240101")).collect()
    assert [r["bar_pct"] for r in got] == [None]


def test_limit_of_zero(spark):
    rows = frame(spark, [ev("a", "x", "2024-01-01 00:00:00")])
    assert E.top_events(rows, "20240101", "20240101", limit=0).collect() == []


def test_second_cohort_value(spark):
    rows = frame(spark, [ev("a", "x", "2024-01-01 00:00:00", platform="IOS"), ev("b", "x", "2024-01-01 00:00:00", platform="WEB")])
    sizes = [len(B.compare_cohorts(rows, "20240101", "20240102", "platform", "IOS", b).collect()) for b in (None, "", "IOS", "WEB")]
    assert sizes == [1, 1, 1, 2]


def test_weeks_and_presets():
    assert week_windows(dt.date(2024, 1, 31)) == ("20240124", "20240130", "20240117", "20240123")
    assert range_preset(7, dt.date(2024, 1, 31)) == ("20240124", "20240130")
