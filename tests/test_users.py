import random
from datetime import date

import pytest

from evlens.operators import intents as T
from evlens.operators import users as U
from tests.helpers import ev, frame


def journey(spark, spec):
    rows = []
    for t, name, sid, eng in spec:
        rows.append(ev("u", name, t, params={"ga_session_id": sid, "engagement_time_msec": eng},
                       country="IN", platform="ANDROID", version="3.1"))
    return frame(spark, rows)


def test_metrics_small_journey(spark):
    df = journey(spark, [("2024-01-01 10:00:00", "open", 1, 30000), ("2024-01-01 10:05:00", "play", 1, 45000),
                         ("2024-01-02 09:00:00", "play", 2, 30000)])
    m = U.user_metrics(df, "20240101", "20240131").first()
    assert (m.event_count, m.session_count, m.active_days, m.lifespan_days) == (3, 2, 2, 1)
    assert m.total_engagement_minutes == 1.8 and m.country == "IN" and m.app_version == "3.1"
    assert [(t.event, t["count"]) for t in m.top_events] == [("play", 2), ("open", 1)]
    assert m.platforms == ["ANDROID"]


def test_patterns(spark):
    power = [(f"2024-01-{d:02d} {h:02d}:{mi:02d}:00", "play", d * 10 + h, 1000)
             for d in range(1, 8) for h in (9, 18) for mi in range(5)]
    one = [("2024-01-01 10:00:00", "open", 1, 0), ("2024-01-01 10:01:00", "close", 1, 0)]
    lab = lambda spec: U.classify(U.user_metrics(journey(spark, spec), "20240101", "20240131"),
                                  date(2024, 1, 8)).first().label
    assert lab(power) == "power_user"
    assert lab(one) == "one_and_done"
    drift = [("2024-01-01 10:00:00", "a", 1, 0), ("2024-01-03 10:00:00", "a", 2, 0),
             ("2024-01-06 10:00:00", "a", 3, 0)] + [("2024-01-06 11:00:00", "a", 3, 0)] * 8
    assert U.classify(U.user_metrics(journey(spark, drift), "20240101", "20240131"),
                      date(2024, 1, 31)).first().label == "drifted_off"
    assert U.classify(U.user_metrics(journey(spark, drift), "20240101", "20240131"),
                      date(2024, 1, 7)).first().label == "returning_visitor"


def test_engagement_rounding_is_exact_half_even(spark):
    col = U.minutes_1dp
    df = spark.createDataFrame([(3000,), (9000,), (105000,), (3001,)], "ms bigint")
    assert [r[0] for r in df.select(col(df.ms)).collect()] == [0.0, 0.2, 1.8, 0.1]


def test_top_events_ties_follow_first_seen(spark):
    df = journey(spark, [("2024-01-01 10:00:00", "b", 1, 0), ("2024-01-01 10:01:00", "a", 1, 0),
                         ("2024-01-01 10:02:00", "a", 1, 0), ("2024-01-01 10:03:00", "b", 1, 0)])
    assert [r.event for r in U.user_top_events(df, "20240101", "20240101").orderBy("rank").collect()] == ["b", "a"]


def test_journey_head_and_tail(spark):
    df = journey(spark, [(f"2024-01-01 10:{m:02d}:00", f"e{m}", 1, 0) for m in range(20)])
    got = U.journeys(df, "20240101", "20240101", first=8, last=4).collect()
    assert sorted(r.seq for r in got) == [-4, -3, -2, -1] + list(range(1, 9))
    assert {r.seq: r.event_name for r in got}[-1] == "e19"
    single = U.user_journey(df, "u", "20240101", "20240101", limit=5).collect()
    assert [r.event_name for r in single] == ["e0", "e1", "e2", "e3", "e4"]


def test_focus_mix(spark):
    top = spark.createDataFrame([("u", 1, "purchase_done", 3), ("u", 2, "level_up", 1), ("u", 3, "x", 10),
                                 ("v", 1, "other", 5)],
                                "user_pseudo_id string, rank int, event string, event_count bigint")
    rows = U.focus_mix(top).collect()
    got = {(r.label, r.pct) for r in rows if r.user_pseudo_id == "u"}
    assert ("Monetization", 75) in got and ("Engagement", 25) in got
    assert not [r for r in rows if r.user_pseudo_id == "v"]


def test_narrative(spark):
    df = journey(spark, [("2024-01-01 10:00:00", "open", 1, 0), ("2024-01-01 10:01:00", "open", 1, 0)])
    n = U.narrative(U.classify(U.user_metrics(df, "20240101", "20240131"), date(2024, 1, 2))).first()
    assert n.narrative.startswith("**Story**: This user generated 2 events across 1 session(s) over 1 active "
                                  "day(s) (lifespan: 0 days). Most frequent action: open.")
    assert "one-and-done" in n.narrative


@pytest.mark.parametrize("question,intent", [
    ("Why is retention low this month?", "retention_overview"),
    ("what's the weather", "off_topic"),
    ("Where do users drop in the funnel?", "where_users_drop"),
    ("show me dau", "growth_check"),
    ("Is there an AHA MOMENT?", "aha_moment"),
    ("top events and churn", "top_events"),        # longest phrase wins
    ("hello there", "unknown"),
    ("retention is bad, tell me a joke", "off_topic"),
])
def test_intents(spark, question, intent):
    df = spark.createDataFrame([(question,)], "text string")
    assert T.tag_intents(df).first().intent == intent


def plain_intent(text, phrases, hints):
    low = (text or "").lower()
    if any(h in low for h in hints):
        return "off_topic"
    found = [(-len(p), i, intent) for i, (intent, ps) in enumerate(phrases.items()) for p in ps if p in low]
    return min(found)[2] if found else "unknown"


@pytest.mark.parametrize("seed", range(3))
def test_own_phrases_against_plain_search(spark, seed):
    """Phrases that begin, hold or overlap one another, with characters that mean something in a pattern."""
    rng = random.Random(seed)
    word = lambda n: "".join(rng.choice("ab.(é😀 ") for _ in range(rng.randint(1, n)))
    phrases = {f"i{k}": [word(4) for _ in range(4)] for k in range(4)}
    hints = [word(5) + "b" for _ in range(2)]
    texts = [None, "", *(word(14).upper() for _ in range(300)), "x" * 200_000 + phrases["i0"][0]]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    got = {r.id: r.intent for r in T.tag_intents(df, phrases=phrases, off_topic=hints).collect()}
    assert got == {i: plain_intent(t, phrases, hints) for i, t in enumerate(texts)}


def test_a_hint_that_begins_a_phrase_still_counts(spark):
    df = spark.createDataFrame([("stock levels",), ("stockings",), ("levels",)], "text string")
    tags = T.tag_intents(df, phrases={"supply": ["stock levels", "levels"]}, off_topic=["stock"])
    assert [r.intent for r in tags.collect()] == ["off_topic", "off_topic", "supply"]
    assert [r.intent for r in T.tag_intents(df, phrases={}, off_topic=[]).collect()] == ["unknown"] * 3
    with pytest.raises(ValueError):
        T.tag_intents(df, phrases={"all": [""]})


def test_narratives_over_trailing_windows(spark):
    spec = [(f"2024-01-{d:02d} 10:00:00", "play", d, 0) for d in range(1, 11)]
    got = {r.days: r.label for r in U.trailing_narratives(journey(spark, spec), "20240110", [1, 3, 9, 10], date(2024, 1, 20)).collect()}
    assert got == {1: "one_and_done", 3: "returning_visitor", 9: "drifted_off", 10: "power_user"}
    with pytest.raises(ValueError):
        U.trailing_narratives(journey(spark, spec), "20240110", [], date(2024, 1, 20))
