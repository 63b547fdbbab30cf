"""Per-user behaviour: journeys (B5, B8), totals (E6), top events (E15), metrics (F25),
pattern labels (F26), template narrative (F27) and focus mix (F28) - for all users.

Every per-user result comes from partial aggregates; per-user top-k uses
``row_number() <= k``, which Spark plans with a partial group limit before the
shuffle, so even a user holding a large share of all rows ships at most k rows per
map task.
"""
from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime, timezone
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evlens.functions.params import param_int, param_string
from evlens.functions.periods import shift
from evlens.functions.timecols import utc_day
from evlens.schema import MICROS_PER_DAY, MICROS_PER_HOUR, NAME, TS, USER
from evlens.sources.scan import scan

# --- fixed values (must match the reference behaviour) -------------------------
JOURNEY_SAMPLE = 50
NARRATIVE_HEAD, NARRATIVE_TAIL = 8, 4
TOP_EVENTS_PER_USER = 8
FOCUS_BUCKETS = (
    ("Monetization", ("purchase", "iap", "subscription", "buy", "payment", "store_view", "cart")),
    ("Engagement", ("mission", "level", "achievement", "play", "session", "game_start", "complete")),
    ("Exploration", ("screen_view", "page_view", "view_item", "browse", "search", "tab_select")),
    ("Social", ("share", "invite", "friend", "chat", "message", "comment", "like")),
)
PATTERNS = {
    "no_data": (1.0, "No events found in this window."),
    "one_and_done": (0.8, "Opened the app once and didn't return."),
    "power_user": (0.9, "Frequent and sustained engagement -- a power user."),
    "drifted_off": (0.7, "Active for a stretch, then went quiet."),
    "returning_visitor": (0.7, "Comes back regularly, moderate engagement."),
    "casual": (0.5, "Light, occasional usage."),
}
PATTERN_TEXT = {
    "one_and_done": "**Pattern**: A 'one-and-done' user — opened the app, did very little, didn't come back. "
                    "This is the most common drop-off pattern in any product.\n\n"
                    "**Recommendations**:\n"
                    "- Investigate why your onboarding flow doesn't hook this segment in their first session.\n"
                    "- Compare retention by acquisition source — paid vs organic users often differ here.",
    "power_user": "**Pattern**: A power user — sustained, high engagement across many days. These users drive the bulk of your usage.\n\n"
                  "**Recommendations**:\n"
                  "- Identify what onboarding actions correlate with becoming a power user (use the 'aha moment' analysis).\n"
                  "- Consider giving this segment beta access to new features for early feedback.",
    "drifted_off": "**Pattern**: Drifted off — was engaged at first, then went quiet. This is the highest-leverage churn pattern: you had them, then lost them.\n\n"
                   "**Recommendations**:\n"
                   "- Look at events in the days before they went quiet — was there a friction point?\n"
                   "- Check whether feature releases or content changes coincided with their drop-off.",
    "returning_visitor": "**Pattern**: A returning visitor — comes back occasionally with moderate engagement. The middle of the funnel — not lost, not loyal yet.\n\n"
                         "**Recommendations**:\n"
                         "- This segment converts to power users with the right nudge. Identify what your top users did at this stage.\n"
                         "- Push notifications or email digests aimed at this group often have outsized ROI.",
    "casual": "**Pattern**: Casual / light user — uses the app occasionally without strong commitment.\n\n"
              "**Recommendations**:\n"
              "- Investigate value-prop clarity in your messaging — casual users often don't understand the full benefit.\n"
              "- Compare retention by the events this user did not do — is there a key activation event they're missing?",
}
NO_DATA_TEXT = ("**Story**: No events found for this user in the selected date range.\n\n"
                "**Pattern**: Insufficient data.\n\n"
                "**Recommendations**: Widen the date range, or verify the user_pseudo_id is correct.")
# -----------------------------------------------------------------------------------


def minutes_1dp(ms: Column) -> Column:
    """``ms`` / 60000 rounded half-even to one decimal, computed exactly on integers."""
    q, r = F.floor(ms / 6000).cast("long"), F.pmod(ms, F.lit(6000))
    tenths = (F.when(r > 3000, q + 1).when(r < 3000, q)
              .otherwise(q + F.pmod(q, F.lit(2))))
    return tenths / 10.0


def _journey_cols() -> list[Column]:
    return [F.col(TS).alias("event_time"), NAME, "platform",
            param_string("page_title").alias("page_title"),
            param_string("screen_name").alias("screen_name"),
            param_int("engagement_time_msec").alias("engagement_msec"),
            param_int("ga_session_id").alias("session_id"),
            F.col("geo.country").alias("country"),
            F.col("device.category").alias("device_category"),
            F.col("device.operating_system").alias("os"),
            F.col("app_info.version").alias("app_version")]


def _journey_order(rows: DataFrame, descending: bool = False) -> list[Column]:
    """Time, name, then every other column: only rows that agree in all of them are interchangeable."""
    names = ["event_time", NAME, *[c for c in rows.columns if c not in ("event_time", NAME, USER)]]
    return [F.col(c).desc_nulls_last() if descending else F.col(c).asc_nulls_first() for c in names]


def user_journey(events: DataFrame, user_id: str, start: str, end: str, limit: int | None = None) -> DataFrame:
    """One user's events in time order (the other columns break ties), all or the first ``limit``."""
    rows = scan(events, start, end).where(F.col(USER) == F.lit(user_id)).select(*_journey_cols())
    ordered = rows.orderBy(*_journey_order(rows))
    return ordered if limit is None else ordered.limit(limit)


def _numbered_per_user(rows: DataFrame, col: str) -> DataFrame:
    """All of each user's rows, numbered from 1 in journey order.

    Numbered within (user, hour of the event); the hours' counts, one small row each,
    say how many rows come before. No task holds more than an hour of a user.
    """
    hour = F.floor(F.col("event_time") / MICROS_PER_HOUR)
    by_hour = rows.withColumn("_hour", hour)
    before = Window.partitionBy(USER).orderBy("_hour").rowsBetween(Window.unboundedPreceding, -1)
    starts = (by_hour.groupBy(USER, "_hour").agg(F.count(F.lit(1)).alias("_n"))
              .select(USER, "_hour", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")))
    place = F.row_number().over(Window.partitionBy(USER, "_hour").orderBy(*_journey_order(rows)))
    return (by_hour.withColumn("_place", place).join(starts, [USER, "_hour"])
            .withColumn(col, (F.col("_before") + F.col("_place")).cast("int")).drop("_place", "_before", "_hour"))


def _first_k_per_user(rows: DataFrame, order: list[Column], k: int, col: str,
                      salt_buckets: int | None = None) -> DataFrame:
    """Each user's first ``k`` rows by ``order``, numbered 1..k in ``col``.

    Two levels of ``row_number() <= k``, each planned with a partial group limit
    ahead of its shuffle. Level 1 groups by (user, input partition mod
    ``salt_buckets``), so one user's candidates are cut to k per map task and spread
    over ``salt_buckets`` tasks; level 2 ranks at most k x ``salt_buckets`` survivors
    per user. A user holding a third of all rows never lands whole in one task.
    The salt follows the number of shuffle partitions unless given.
    """
    salt_buckets = salt_buckets or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salt = F.pmod(F.spark_partition_id(), F.lit(salt_buckets))
    lvl1 = (rows.withColumn("_salt", salt)
            .withColumn("_r1", F.row_number().over(Window.partitionBy(USER, "_salt").orderBy(*order)))
            .where(F.col("_r1") <= k).drop("_salt", "_r1"))
    return (lvl1.withColumn(col, F.row_number().over(Window.partitionBy(USER).orderBy(*order)))
            .where(F.col(col) <= k))


def journeys(events: DataFrame, start: str, end: str, first: int | None = None,
             last: int = 0) -> DataFrame:
    """B5 / B8 for all users: all events, or each user's first ``first`` and last ``last``.

    Columns: user_pseudo_id, seq (1-based from the start, or negative from the end),
    then the journey columns.
    """
    rows = scan(events, start, end).where(F.col(USER).isNotNull()).select(USER, *_journey_cols())
    out = _numbered_per_user(rows, "seq") if first is None else None
    if first:
        out = _first_k_per_user(rows, _journey_order(rows), first, "seq")
    if last:
        tail = (_first_k_per_user(rows, _journey_order(rows, descending=True), last, "seq")
                .withColumn("seq", -F.col("seq")))
        out = tail if out is None else out.unionByName(tail)
    cols = [c for c in out.columns if c not in (USER, "seq")]
    return out.select(USER, "seq", *cols)


def _session_day_parts(window: DataFrame, by_event: bool = False, attributes: bool = False) -> DataFrame:
    """Per (user, session id, UTC day[, event][, app version, platform, country]):
    the partial aggregate every per-user metric is merged from (a user contributes
    one row per session-day, not per event).

    Only counts, min / max times and sums are aggregated here, so the pass over raw
    events is a hash aggregate; string attributes ride in the grouping key (they
    rarely vary inside a session-day) and are resolved later on the reduced rows.
    """
    keys = [USER, param_int("ga_session_id").alias("sid"), utc_day().alias("day")]
    if by_event:
        keys.append(F.col(NAME))
    if attributes:
        keys += [F.col("app_info.version").alias("v"),
                 F.when(F.col("platform") != "", F.col("platform")).alias("plat"),
                 F.when(F.col("geo.country") != "", F.col("geo.country")).alias("ctry")]
    return (window.where(F.col(USER).isNotNull())
            .groupBy(*keys)
            .agg(F.count(F.lit(1)).alias("n"),
                 F.min(TS).alias("first_t"), F.max(TS).alias("last_t"),
                 F.sum(F.coalesce(param_int("engagement_time_msec"), F.lit(0))).alias("eng")))


def user_totals(events: DataFrame, start: str, end: str) -> DataFrame:
    """E6 for every user: events, distinct sessions, active UTC days, first / last seen
    (micros) and engagement minutes (NULL engagement as 0, rounded to 1 decimal)."""
    parts = _session_day_parts(scan(events, start, end))
    return (parts.groupBy(USER)
            .agg(F.sum("n").cast("long").alias("event_count"),
                 F.count_distinct("sid").alias("session_count"),
                 F.count_distinct("day").alias("active_days"),
                 F.min("first_t").alias("first_seen"), F.max("last_t").alias("last_seen"),
                 minutes_1dp(F.sum("eng")).alias("total_engagement_minutes")))


def user_top_events(events: DataFrame, start: str, end: str, k: int | None = TOP_EVENTS_PER_USER) -> DataFrame:
    """Each user's ``k`` most frequent events, or all; ties go to the event seen first.

    Columns: user_pseudo_id, rank, event, event_count.
    """
    counts = (scan(events, start, end).where(F.col(USER).isNotNull() & F.col(NAME).isNotNull())
              .groupBy(USER, NAME).agg(F.count(F.lit(1)).alias("event_count"), F.min(TS).alias("first_t")))
    return _rank_events(counts, k)


def _rank_events(counts: DataFrame, k: int | None) -> DataFrame:
    # NULL names rank after every named event and are dropped after ranking, so the
    # input needs no filter (which would differ from the shared aggregate's plan).
    w = Window.partitionBy(USER).orderBy(F.col(NAME).isNull(), F.col("event_count").desc(),
                                         F.col("first_t").asc(), F.col(NAME).asc())
    ranked = counts.withColumn("rank", F.row_number().over(w))
    return ((ranked if k is None else ranked.where(F.col("rank") <= k))
            .where(F.col(NAME).isNotNull())
            .select(USER, "rank", F.col(NAME).alias("event"), "event_count"))


def user_metrics(events: DataFrame, start: str, end: str) -> DataFrame:
    """E6 totals plus top events, platforms, country (smallest seen), app version
    of the first event and lifespan in UTC days, one row per user.

    One scan: a (user, session, day, event) partial aggregate feeds both the totals
    and the per-user event ranking (its shuffle is reused)."""
    parts = _session_day_parts(scan(events, start, end), by_event=True, attributes=True)
    base = (parts.groupBy(USER)
            .agg(F.sum("n").cast("long").alias("event_count"),
                 F.count_distinct("sid").alias("session_count"),
                 F.count_distinct("day").alias("active_days"),
                 F.min("first_t").alias("first_seen"), F.max("last_t").alias("last_seen"),
                 minutes_1dp(F.sum("eng")).alias("total_engagement_minutes"),
                 F.min(F.struct(F.col("first_t"), F.col("v"))).alias("first_ver"),
                 # distinct platforms of the user: bounded by the platform vocabulary
                 F.array_sort(F.collect_set("plat")).alias("platforms"),
                 F.min("ctry").alias("country")))
    counts = parts.groupBy(USER, NAME).agg(F.sum("n").alias("event_count"), F.min("first_t").alias("first_t"))
    top = (_rank_events(counts, TOP_EVENTS_PER_USER)
           .groupBy(USER)
           .agg(F.array_sort(F.collect_list(F.struct("rank", "event", "event_count"))).alias("_top")))
    lifespan = (F.floor(F.col("last_seen") / MICROS_PER_DAY) - F.floor(F.col("first_seen") / MICROS_PER_DAY))
    return (base.join(top, USER, "left")
            .select(USER, "event_count", "session_count", "total_engagement_minutes", "first_seen", "last_seen",
                    "active_days", lifespan.cast("int").alias("lifespan_days"),
                    F.transform(F.coalesce(F.col("_top"), F.array()),
                                lambda t: F.struct(t["event"].alias("event"), t["event_count"].alias("count")))
                    .alias("top_events"),
                    "platforms", "country", F.col("first_ver")["v"].alias("app_version")))


def _as_of_micros(as_of: date | datetime) -> int:
    if not isinstance(as_of, datetime):
        as_of = datetime(as_of.year, as_of.month, as_of.day, tzinfo=timezone.utc)
    elif as_of.tzinfo is None:
        as_of = as_of.replace(tzinfo=timezone.utc)
    return int(as_of.timestamp()) * 1_000_000 + as_of.microsecond


def classify(metrics: DataFrame, as_of: date | datetime) -> DataFrame:
    """first matching pattern wins; ``as_of`` replaces the wall clock."""
    ev, se, days, life = (F.col("event_count"), F.col("session_count"), F.col("active_days"),
                          F.col("lifespan_days"))
    since_last = F.floor((F.lit(_as_of_micros(as_of)) - F.col("last_seen")) / MICROS_PER_DAY)
    label = (F.when(F.coalesce(ev, F.lit(0)) == 0, F.lit("no_data"))
             .when((se <= 1) & (ev < 10), F.lit("one_and_done"))
             .when((se >= 10) & (days >= 7), F.lit("power_user"))
             .when((life >= 5) & (since_last > life * 0.5), F.lit("drifted_off"))
             .when((se >= 3) & (days >= 3), F.lit("returning_visitor"))
             .otherwise(F.lit("casual")))
    conf = F.create_map(*[x for k, (c, _) in PATTERNS.items() for x in (F.lit(k), F.lit(c))])
    desc = F.create_map(*[x for k, (_, d) in PATTERNS.items() for x in (F.lit(k), F.lit(d))])
    return (metrics.withColumn("label", label)
            .withColumn("confidence", conf[F.col("label")])
            .withColumn("description", desc[F.col("label")]))


def narrative(patterns: DataFrame) -> DataFrame:
    """deterministic narrative per user from metrics and pattern label."""
    top_event = F.coalesce(F.col("top_events")[0]["event"], F.lit("no events"))
    story = F.format_string(
        "**Story**: This user generated %d events across %d session(s) over %d active day(s) "
        "(lifespan: %d days). Most frequent action: %s.\n\n",
        F.col("event_count"), F.col("session_count"), F.col("active_days"), F.col("lifespan_days"), top_event)
    texts = F.create_map(*[x for k, v in PATTERN_TEXT.items() for x in (F.lit(k), F.lit(v))])
    fallback = F.lit("**Pattern**: Atypical pattern. Not enough signal to classify confidently.\n\n"
                     "**Recommendations**: Use the breakdown features to compare this user's segment "
                     "against your power users.")
    text = F.when(F.col("label") == "no_data", F.lit(NO_DATA_TEXT)).otherwise(
        F.concat(story, F.coalesce(texts[F.col("label")], fallback)))
    return patterns.select(USER, "label", text.alias("narrative"))


def trailing_narratives(events: DataFrame, end: str, lengths: Sequence[int], as_of: date | datetime) -> DataFrame:
    """F26 and F27 over several trailing windows: for each length in days, every user's label and narrative
    in the window of that many days up to ``end``. Columns: days, user_pseudo_id, label, narrative.

    A user's label moves with the window (one-and-done today, a power user over ten days).
    Each window is its own bounded scan and per-user aggregate.
    """
    parts = [narrative(classify(user_metrics(events, shift(end, 1 - n), end), as_of)).withColumn("days", F.lit(n))
             for n in lengths]
    if not parts:
        raise ValueError("trailing_narratives needs a window length")
    return reduce(DataFrame.unionByName, parts).select("days", USER, "label", "narrative")


def focus_mix(top_events: DataFrame) -> DataFrame:
    """share of each keyword bucket in a user's top events (``user_top_events``).

    An event goes to the first bucket with a keyword contained in its lower-cased
    name; shares are of the categorised count (of all top-event counts when nothing
    is categorised), rounded half up to whole percent. Users whose shares are all 0
    get no rows. Columns: user_pseudo_id, position, label, pct.
    """
    name = F.lower(F.col("event"))
    bucket = None
    for label, words in FOCUS_BUCKETS:
        hit = None
        for w in words:
            h = name.contains(w)
            hit = h if hit is None else hit | h
        bucket = F.when(hit, F.lit(label)) if bucket is None else bucket.when(hit, F.lit(label))
    per = (top_events.withColumn("bucket", bucket)
           .groupBy(USER)
           .agg(*[F.sum(F.when(F.col("bucket") == lbl, F.col("event_count")).otherwise(F.lit(0))).alias(f"b{i}")
                  for i, (lbl, _) in enumerate(FOCUS_BUCKETS)],
                F.sum("event_count").alias("total")))
    categorized = sum((F.col(f"b{i}") for i in range(len(FOCUS_BUCKETS))), F.lit(0))
    base = F.when(categorized > 0, categorized).otherwise(F.col("total"))
    rows = F.array(*[F.struct(F.lit(i).alias("order"), F.lit(lbl).alias("label"),
                              F.when(base > 0, F.floor(F.col(f"b{i}") / base * 100 + 0.5)).otherwise(F.lit(0))
                              .cast("int").alias("pct"))
                     for i, (lbl, _) in enumerate(FOCUS_BUCKETS)])
    exploded = per.select(USER, F.explode(rows).alias("r")).select(USER, "r.*")
    w = Window.partitionBy(USER).orderBy(F.col("pct").desc(), F.col("order").asc())
    shown = F.max("pct").over(Window.partitionBy(USER))
    return (exploded.withColumn("position", F.row_number().over(w)).withColumn("_shown", shown)
            .where(F.col("_shown") > 0).select(USER, "position", "label", "pct"))
