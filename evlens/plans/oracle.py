"""DuckDB oracle SQL for every registered query.

Written in the literal form of the reference's SQL (self-joins, cross joins,
``COUNT(DISTINCT IF ...)``), so the rewritten Spark plans are checked against an
independent formulation. Every statement starts from the same flat ``ev`` CTE over
the pre-registered tables. Doubles are rounded to 6 digits, dates cast to strings.
"""
from __future__ import annotations

from evlens.plans import fixture as fx

DAY_US = 86_400_000_000
HOUR_US = 3_600_000_000

EV = f"""ev AS (
  SELECT strftime(e.ts, '%Y%m%d') AS event_date,
         epoch_us(e.ts) AS event_timestamp,
         e.event_type AS event_name,
         CAST(e.user_id AS VARCHAR) AS user_pseudo_id,
         CASE e.user_id % 3 WHEN 0 THEN 'ANDROID' WHEN 1 THEN 'IOS' ELSE 'WEB' END AS platform,
         n.n_name AS country,
         r.r_name AS region,
         CASE e.user_id % 2 WHEN 0 THEN 'mobile' ELSE 'desktop' END AS device_category,
         '2.' || CAST(CAST(json_extract_string(e.props, '$.k') AS INT) // 20 AS VARCHAR) AS app_version,
         CAST(json_extract_string(e.props, '$.k') AS BIGINT) AS k,
         CAST(round(e.value * 1000) AS BIGINT) AS engagement_msec,
         CAST(strftime(e.ts, '%Y%m%d') AS BIGINT) AS session_id,
         e.event_type AS screen_name,
         c.c_mktsegment AS segment,
         CAST(epoch_us(e.ts) // {DAY_US} AS INTEGER) AS uday
  FROM events e
  LEFT JOIN customer c ON e.user_id = c.c_custkey
  LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
  LEFT JOIN region r ON n.n_regionkey = r.r_regionkey
)"""


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def with_ev(body: str, extra_ctes: str = "") -> str:
    ctes = EV + (",\n" + extra_ctes if extra_ctes else "")
    return f"WITH {ctes}\n{body}"


def rounded(sql: str, cols: list[str]) -> str:
    rep = ", ".join(f"ROUND({c}, 6) AS {c}" for c in cols)
    return f"SELECT * REPLACE ({rep}) FROM ({sql}) AS t"


def between(s: str, e: str, col: str = "event_date") -> str:
    return f"{col} BETWEEN {q(s)} AND {q(e)}"


# ---------------------------------------------------------------- step 1
def canonical_events() -> str:
    return with_ev("""SELECT event_date, event_timestamp, event_name, user_pseudo_id, platform,
       country, region, device_category, app_version, k AS param_k,
       engagement_msec, session_id, screen_name, segment
FROM ev""")


def event_param_sample() -> str:
    return with_ev(f"""SELECT user_pseudo_id, event_timestamp AS event_time,
       CAST(NULL AS VARCHAR) AS param_string, k AS param_int, CAST(NULL AS DOUBLE) AS param_double
FROM ev WHERE {between(fx.START, fx.END)} AND event_name = 'purchase'
ORDER BY event_time, user_pseudo_id LIMIT 100""")


# ---------------------------------------------------------------- step 2
def funnel_sql(steps: list[str], s: str, e: str, window: int, strict: bool = False,
               cohort_where: str | None = None, round_result: bool = True) -> str:
    n = len(steps)
    mins = ",\n    ".join(
        f"MIN(CASE WHEN event_name = {q(ev)} THEN event_timestamp END) AS s{i}"
        for i, ev in enumerate(steps, 1))
    cohort_join = ""
    extra = ""
    if cohort_where:
        extra = (f"cohort_users AS (SELECT DISTINCT user_pseudo_id FROM ev "
                 f"WHERE {between(s, e)} AND ({cohort_where})),\n")
        cohort_join = "JOIN cohort_users cu USING (user_pseudo_id)"
    in_list = ", ".join(q(x) for x in steps)

    def cond(i: int) -> str:
        c = f"s{i} IS NOT NULL AND s{i} > s{i-1} AND (s{i} - s1) // {DAY_US} <= {window}"
        if strict:
            for j in range(2, i):
                c += f" AND s{j} > s{j-1} AND (s{j} - s1) // {DAY_US} <= {window}"
        return c

    counts = ["COUNT(DISTINCT CASE WHEN s1 IS NOT NULL THEN user_pseudo_id END) AS c1"]
    counts += [f"COUNT(DISTINCT CASE WHEN {cond(i)} THEN user_pseudo_id END) AS c{i}"
               for i in range(2, n + 1)]
    rows = []
    for i, ev in enumerate(steps, 1):
        drop = ("CAST(NULL AS DOUBLE)" if i == 1 else
                f"CASE WHEN c{i-1} > 0 THEN (c{i-1} - c{i}) / c{i-1} END")
        conv = f"CASE WHEN c1 <> 0 THEN c{i} / c1 ELSE 0.0 END"
        rows.append(f"SELECT {i} AS step_index, {q(ev)} AS event, c{i} AS users, "
                    f"CAST({drop} AS DOUBLE) AS drop_off_from_prev_pct, "
                    f"CAST({conv} AS DOUBLE) AS conversion_from_start_pct FROM cnt")
    body = "\nUNION ALL\n".join(rows)
    ctes = f"""{extra}step_events AS (
  SELECT e.user_pseudo_id, e.event_name, e.event_timestamp
  FROM ev e {cohort_join}
  WHERE {between(s, e, 'e.event_date')} AND e.event_name IN ({in_list})
),
ust AS (
  SELECT user_pseudo_id,
    {mins}
  FROM step_events GROUP BY user_pseudo_id
),
cnt AS (SELECT {', '.join(counts)} FROM ust)"""
    if not round_result:
        return with_ev(body, ctes)
    return rounded(with_ev(body, ctes), ["drop_off_from_prev_pct", "conversion_from_start_pct"])


def funnel() -> str:
    return funnel_sql(fx.FUNNEL_STEPS, fx.START, fx.END, fx.WINDOW_DAYS)


def funnel_strict() -> str:
    return funnel_sql(fx.FUNNEL_STEPS, fx.START, fx.END, fx.WINDOW_DAYS, strict=True)


# ---------------------------------------------------------------- step 3 / 4
def top_events_sql(s: str, e: str, limit: int, cohort_where: str | None = None) -> str:
    extra, join = "", ""
    if cohort_where:
        extra = (f"cohort_users AS (SELECT DISTINCT user_pseudo_id FROM ev "
                 f"WHERE {between(s, e)} AND ({cohort_where}))")
        join = "JOIN cohort_users cu USING (user_pseudo_id)"
    body = f"""SELECT e.event_name, COUNT(*) AS event_count, COUNT(DISTINCT e.user_pseudo_id) AS unique_users
FROM ev e {join}
WHERE {between(s, e, 'e.event_date')}
GROUP BY e.event_name
ORDER BY event_count DESC, e.event_name
LIMIT {limit}"""
    return with_ev(body, extra)


COHORT_SQL = {
    "cohort_not_equals": "region IS NULL OR region != 'ASIA'",
    "cohort_in": "country IN ('NATION_1', 'NATION_2', 'NATION_3', 'NATION_4')",
    "cohort_not_in": "device_category IS NULL OR device_category NOT IN ('mobile')",
    "cohort_contains": "country LIKE '%_1%'",
    "cohort_starts_with": "country LIKE 'NATION_2%'",
    "cohort_user_property": "segment = 'BUILDING'",
}
FUNNEL_COHORT_SQL = {
    "cohort_equals": "platform = 'IOS'",
    "cohort_and": "(app_version = '2.0') AND (screen_name = 'purchase')",
    "cohort_event_param": "CAST(k AS VARCHAR) IN ('7', '8', '9', '10', '11')",
}


def cohort_row_level() -> str:
    return with_ev(f"""SELECT event_name, COUNT(*) AS event_count, COUNT(DISTINCT user_pseudo_id) AS unique_users
FROM ev WHERE {between(fx.START, fx.END)} AND app_version LIKE '2.1%' AND platform IN ('IOS', 'WEB')
GROUP BY event_name""")


def top_events() -> str:
    return top_events_sql(fx.START, fx.END, 50)


def top_events_last_7() -> str:
    return top_events_sql("20240124", "20240130", 50)


def top_events_cohort() -> str:
    return top_events_sql(fx.START, fx.END, 50, "region IN ('EUROPE', 'AMERICA')")


def daily_activity_sql(s: str, e: str) -> str:
    return with_ev(f"""SELECT CAST(CAST(strptime(event_date, '%Y%m%d') AS DATE) AS VARCHAR) AS day,
       COUNT(DISTINCT user_pseudo_id) AS dau
FROM ev WHERE {between(s, e)} GROUP BY day ORDER BY day""")


def daily_activity() -> str:
    return daily_activity_sql(fx.START, fx.END)


def active_users() -> str:
    return with_ev(f"SELECT COUNT(DISTINCT user_pseudo_id) AS active_users FROM ev WHERE {between(fx.START, fx.END)}")


def total_events() -> str:
    return with_ev(f"SELECT COUNT(*) AS total_events FROM ev WHERE {between(fx.START, fx.END)}")


def recent_users() -> str:
    return with_ev(f"""SELECT user_pseudo_id, COUNT(*) AS event_count, MIN(event_timestamp) AS first_seen,
       MAX(event_timestamp) AS last_seen, COUNT(DISTINCT uday) AS active_days
FROM ev WHERE {between(fx.START, fx.END)} AND user_pseudo_id IS NOT NULL
GROUP BY user_pseudo_id ORDER BY event_count DESC, user_pseudo_id LIMIT 20""")


def freshness() -> str:
    return with_ev("""SELECT MAX(event_timestamp) AS latest_event, COUNT(DISTINCT event_date) AS days_with_data
FROM ev WHERE event_date BETWEEN '20240128' AND '20240131'""")


def field_discovery() -> str:
    cols = [("geo.country", "Country"), ("geo.region", "Region"), ("geo.city", "City"),
            ("platform", "Platform"), ("device.category", "Device category"),
            ("device.operating_system", "OS"), ("app_info.version", "App version"),
            ("traffic_source.source", "Traffic source"), ("traffic_source.medium", "Traffic medium")]
    values = ", ".join(f"({q(f)}, {q(lbl)})" for f, lbl in cols)
    return with_ev(f"""SELECT 'column' AS field_type, f AS field, l AS label FROM (VALUES {values}) AS t(f, l)
UNION ALL
SELECT DISTINCT 'user_property', 'segment', 'segment' FROM ev WHERE event_date = {q(fx.END)}
UNION ALL
SELECT DISTINCT 'event_param', x, x
FROM (SELECT unnest(['k', 'engagement_time_msec', 'ga_session_id', 'screen_name']) AS x
      FROM ev WHERE event_date = {q(fx.END)})""")


# ---------------------------------------------------------------- step 5
def retention_sql(s: str, e: str, cohort_where: str | None = None) -> str:
    """Per user the first active day and the set of active days; a cohort is the users of one first day."""
    who = (f" AND user_pseudo_id IN (SELECT user_pseudo_id FROM ev WHERE {between(s, e)} AND ({cohort_where}))"
           if cohort_where else "")
    users = f"""users AS (
  SELECT user_pseudo_id, MIN(uday) AS day0, list(DISTINCT uday) AS days
  FROM ev WHERE {between(s, e)} AND user_pseudo_id IS NOT NULL{who} GROUP BY user_pseudo_id
)"""
    back = {n: f"COUNT(*) FILTER (WHERE list_contains(days, day0 + {n}))" for n in (1, 7, 30)}
    return with_ev(f"""SELECT CAST(DATE '1970-01-01' + day0 AS VARCHAR) AS cohort_date, COUNT(*) AS cohort_size,
       {", ".join(f"{c} AS d{n}_users" for n, c in back.items())},
       {", ".join(f"{c} / COUNT(*) AS d{n}_rate" for n, c in back.items())}
FROM users GROUP BY day0 ORDER BY day0""", users)


def retention() -> str:
    return rounded(retention_sql(fx.START, fx.END), ["d1_rate", "d7_rate", "d30_rate"])


def retention_cohort() -> str:
    return rounded(retention_sql(fx.START, fx.END, "platform IN ('ANDROID', 'WEB')"),
                   ["d1_rate", "d7_rate", "d30_rate"])


def headline_sql(retention_query: str, group: str | None = None) -> str:
    g = f"{group}, " if group else ""
    gb = f" GROUP BY {group}" if group else ""
    avg = lambda n: (f"CASE WHEN COALESCE(SUM(cohort_size), 0) > 0 "  # noqa: E731
                     f"THEN SUM(d{n}_users) / SUM(cohort_size) ELSE 0.0 END AS d{n}_avg")
    return f"""SELECT {g}{avg(1)}, {avg(7)}, {avg(30)},
       CAST(COALESCE(SUM(d1_users), 0) AS BIGINT) AS d1_retained,
       CAST(COALESCE(SUM(d7_users), 0) AS BIGINT) AS d7_retained,
       CAST(COALESCE(SUM(d30_users), 0) AS BIGINT) AS d30_retained,
       CAST(COALESCE(SUM(cohort_size), 0) AS BIGINT) AS total_users
FROM ({retention_query}) AS r{gb}"""


def retention_headline() -> str:
    return rounded(headline_sql(retention_sql(fx.START, fx.END)), ["d1_avg", "d7_avg", "d30_avg"])


def retention_maturity() -> str:
    return f"""SELECT MIN(cohort_date) AS earliest_cohort, CAST(DATE '2024-01-31' - CAST(MIN(cohort_date) AS DATE) AS INTEGER) AS days_span,
       CAST(DATE '2024-01-31' - CAST(MIN(cohort_date) AS DATE) AS INTEGER) >= 1 AS d1_ready,
       CAST(DATE '2024-01-31' - CAST(MIN(cohort_date) AS DATE) AS INTEGER) >= 7 AS d7_ready,
       CAST(DATE '2024-01-31' - CAST(MIN(cohort_date) AS DATE) AS INTEGER) >= 30 AS d30_ready
FROM ({retention_sql(fx.START, fx.END)}) AS r"""


# ---------------------------------------------------------------- step 6
def suggest_steps() -> str:
    """Events strictly between a user's first signup and first purchase, by users who have them."""
    return with_ev(f"""SELECT 0 AS position, 'signup' AS event_name
UNION ALL
SELECT CAST(ROW_NUMBER() OVER (ORDER BY n DESC, event_name) AS INTEGER) AS place, event_name
FROM (SELECT event_name, COUNT(DISTINCT user_pseudo_id) AS n FROM ev AS m
      WHERE {between(fx.START, fx.END)} AND event_name NOT IN ('signup', 'purchase')
        AND EXISTS (SELECT 1 FROM spans WHERE spans.user_pseudo_id = m.user_pseudo_id
                    AND m.event_timestamp BETWEEN lo + 1 AND hi - 1)
      GROUP BY event_name) AS between_them
QUALIFY place <= 5
UNION ALL
SELECT 6, 'purchase'""", f"""spans AS (
  SELECT user_pseudo_id, MIN(event_timestamp) FILTER (WHERE event_name = 'signup') AS lo,
         MIN(event_timestamp) FILTER (WHERE event_name = 'purchase') AS hi
  FROM ev WHERE {between(fx.START, fx.END)} GROUP BY user_pseudo_id
)""")


def values_cte(field_sql: str, s: str, e: str, top_n: int, base_where: str | None = None) -> str:
    base = f" AND ({base_where})" if base_where else ""
    return f"""vals AS (
  SELECT value, COUNT(DISTINCT user_pseudo_id) AS users
  FROM (SELECT {field_sql} AS value, user_pseudo_id FROM ev WHERE {between(s, e)}{base}) AS x
  GROUP BY value HAVING value IS NOT NULL AND value <> ''
  ORDER BY users DESC, value LIMIT {top_n}
)"""


def breakdown_values() -> str:
    return with_ev("SELECT value, users FROM vals ORDER BY users DESC, value",
                   values_cte("CAST(k AS VARCHAR)", fx.START, fx.END, 5, "device_category = 'desktop'"))


def members_cte(field_sql: str, s: str, e: str, base_where: str | None = None) -> str:
    base = f" AND ({base_where})" if base_where else ""
    return f"""cohort_users AS (
  SELECT DISTINCT v.value, e.user_pseudo_id
  FROM ev e JOIN vals v ON {field_sql} = v.value
  WHERE {between(s, e, 'e.event_date')}{base}
)"""


def funnel_breakdown() -> str:
    steps, n, w = fx.FUNNEL_STEPS, len(fx.FUNNEL_STEPS), fx.WINDOW_DAYS
    mins = ", ".join(f"MIN(CASE WHEN event_name = {q(ev)} THEN event_timestamp END) AS s{i}"
                     for i, ev in enumerate(steps, 1))
    counts = ["COUNT(DISTINCT CASE WHEN s1 IS NOT NULL THEN user_pseudo_id END) AS c1"]
    counts += [f"COUNT(DISTINCT CASE WHEN s{i} IS NOT NULL AND s{i} > s{i-1} "
               f"AND (s{i} - s1) // {DAY_US} <= {w} THEN user_pseudo_id END) AS c{i}" for i in range(2, n + 1)]
    in_list = ", ".join(q(x) for x in steps)
    ctes = ",\n".join([
        values_cte("CAST(k AS VARCHAR)", fx.START, fx.END, 5),
        members_cte("CAST(e.k AS VARCHAR)", fx.START, fx.END),
        f"""step_events AS (
  SELECT cu.value, e.user_pseudo_id, e.event_name, e.event_timestamp
  FROM ev e JOIN cohort_users cu USING (user_pseudo_id)
  WHERE {between(fx.START, fx.END, 'e.event_date')} AND e.event_name IN ({in_list})
)""",
        f"ust AS (SELECT value, user_pseudo_id, {mins} FROM step_events GROUP BY value, user_pseudo_id)",
        f"cnt0 AS (SELECT value, {', '.join(counts)} FROM ust GROUP BY value)",
        "cnt AS (SELECT vals.value, vals.users, "
        + ", ".join(f"COALESCE(cnt0.c{i}, 0) AS c{i}" for i in range(1, n + 1))
        + " FROM vals LEFT JOIN cnt0 USING (value))",
    ])
    rows = []
    for i, ev in enumerate(steps, 1):
        drop = ("CAST(NULL AS DOUBLE)" if i == 1 else
                f"CASE WHEN c{i-1} > 0 THEN (c{i-1} - c{i}) / c{i-1} END")
        rows.append(f"SELECT value AS series_label, users AS series_users, {i} AS step_index, {q(ev)} AS event, "
                    f"c{i} AS users, CAST({drop} AS DOUBLE) AS drop_off_from_prev_pct, "
                    f"CAST(CASE WHEN c1 <> 0 THEN c{i} / c1 ELSE 0.0 END AS DOUBLE) AS conversion_from_start_pct FROM cnt")
    return rounded(with_ev("\nUNION ALL\n".join(rows), ctes),
                   ["drop_off_from_prev_pct", "conversion_from_start_pct"])


def retention_by_value_sql(field_sql: str, field_e_sql: str, vals: str) -> str:
    ctes = ",\n".join([vals, members_cte(field_e_sql, fx.START, fx.END), f"""first_seen AS (
  SELECT cu.value, e.user_pseudo_id, MIN(e.uday) AS cohort_day
  FROM ev e JOIN cohort_users cu USING (user_pseudo_id)
  WHERE {between(fx.START, fx.END, 'e.event_date')} GROUP BY cu.value, e.user_pseudo_id
),
activity AS (
  SELECT DISTINCT cu.value, e.user_pseudo_id, e.uday AS active_day
  FROM ev e JOIN cohort_users cu USING (user_pseudo_id)
  WHERE {between(fx.START, fx.END, 'e.event_date')}
),
joined AS (
  SELECT fs.value, fs.cohort_day, fs.user_pseudo_id, a.active_day - fs.cohort_day AS day_offset
  FROM first_seen fs JOIN activity a ON fs.user_pseudo_id = a.user_pseudo_id AND fs.value = a.value
  WHERE a.active_day - fs.cohort_day BETWEEN 0 AND 30
),
cohort_sizes AS (
  SELECT value, cohort_day, COUNT(DISTINCT user_pseudo_id) AS cohort_size FROM first_seen GROUP BY value, cohort_day
),
per_cohort AS (
  SELECT j.value, cs.cohort_size,
    COUNT(CASE WHEN j.day_offset = 1 THEN 1 END) AS d1_users,
    COUNT(CASE WHEN j.day_offset = 7 THEN 1 END) AS d7_users,
    COUNT(CASE WHEN j.day_offset = 30 THEN 1 END) AS d30_users
  FROM joined j JOIN cohort_sizes cs ON j.value = cs.value AND j.cohort_day = cs.cohort_day
  GROUP BY j.value, j.cohort_day, cs.cohort_size
),
heads AS (
  SELECT value, SUM(cohort_size) AS tot, SUM(d1_users) AS r1, SUM(d7_users) AS r7, SUM(d30_users) AS r30
  FROM per_cohort GROUP BY value
)"""])
    body = """SELECT vals.value AS series_label, vals.users AS series_users,
  CASE WHEN COALESCE(tot, 0) > 0 THEN r1 / tot ELSE 0.0 END AS d1_rate,
  CASE WHEN COALESCE(tot, 0) > 0 THEN r7 / tot ELSE 0.0 END AS d7_rate,
  CASE WHEN COALESCE(tot, 0) > 0 THEN r30 / tot ELSE 0.0 END AS d30_rate,
  CAST(COALESCE(tot, 0) AS BIGINT) AS total_users
FROM vals LEFT JOIN heads USING (value)"""
    return rounded(with_ev(body, ctes), ["d1_rate", "d7_rate", "d30_rate"])


def retention_breakdown() -> str:
    return retention_by_value_sql("region", "e.region", values_cte("region", fx.START, fx.END, 5))


def compare_cohorts() -> str:
    vals = f"""vals AS (
  SELECT w.value, COUNT(DISTINCT x.user_pseudo_id) AS users
  FROM (VALUES ('BUILDING'), ('MACHINERY')) AS w(value)
  LEFT JOIN (SELECT segment AS value, user_pseudo_id FROM ev WHERE {between(fx.START, fx.END)}) AS x
    ON x.value = w.value
  GROUP BY w.value
)"""
    return retention_by_value_sql("segment", "e.segment", vals)


# ---------------------------------------------------------------- step 7
def pct_sql(x: str) -> str:
    return f"(printf('%.1f', round(({x}) * 100, 1)) || '%')"


def conversion_sql(this: tuple[str, str], last: tuple[str, str], window: int, ordered: bool = False) -> str:
    """A user who starts in a period converts if some purchase of the period lies 0 to ``window`` whole days on."""
    def starters(rng):
        after = " AND b.event_timestamp >= a.event_timestamp" if ordered else ""
        return f"""SELECT user_pseudo_id, EXISTS (
    SELECT 1 FROM ev AS b WHERE b.user_pseudo_id = a.user_pseudo_id AND {between(*rng, "b.event_date")}
      AND b.event_name = 'purchase'{after}
      AND (b.event_timestamp - a.event_timestamp) // {DAY_US} BETWEEN 0 AND {window}) AS done
  FROM ev AS a WHERE {between(*rng)} AND event_name = 'signup'"""

    counted = ",\n".join(f"""{name} AS (
  SELECT COUNT(DISTINCT user_pseudo_id) AS starts, COUNT(DISTINCT user_pseudo_id) FILTER (WHERE done) AS finishes
  FROM ({starters(rng)}) AS x)""" for name, rng in (("now_", this), ("then_", last)))
    return with_ev("""SELECT now_.starts AS this_starts, now_.finishes AS this_finishes,
       now_.finishes / NULLIF(now_.starts, 0) AS this_rate, then_.starts AS last_starts,
       then_.finishes AS last_finishes, then_.finishes / NULLIF(then_.starts, 0) AS last_rate
FROM now_, then_""", counted)


def conversion_change() -> str:
    return rounded(conversion_sql(fx.THIS_WEEK, fx.LAST_WEEK, fx.WINDOW_DAYS), ["this_rate", "last_rate"])


def conversion_change_ordered() -> str:
    return rounded(conversion_sql(fx.THIS_WEEK, fx.LAST_WEEK, fx.WINDOW_DAYS, ordered=True),
                   ["this_rate", "last_rate"])


def correlation_sql(s: str, e: str, min_users: int, limit: int = 10) -> str:
    """Every user against every early event: who has it in the first 24 hours (whole hours), who is back on day 7."""
    facts = f"""born AS (
  SELECT user_pseudo_id, MIN(event_timestamp) AS t0, list_contains(list(uday), MIN(uday) + 7) AS back
  FROM ev WHERE {between(s, e)} AND user_pseudo_id IS NOT NULL GROUP BY user_pseudo_id
),
users AS (
  SELECT born.user_pseudo_id, any_value(back) AS back, list(DISTINCT event_name) AS early
  FROM born JOIN ev ON ev.user_pseudo_id = born.user_pseudo_id AND {between(s, e)}
    AND (event_timestamp - t0) // {HOUR_US} <= 24
  GROUP BY born.user_pseudo_id
),
grid AS (
  SELECT name, list_contains(early, name) AS has, back
  FROM (SELECT DISTINCT unnest(early) AS name FROM users) AS names, users
)"""
    rate = "COUNT(*) FILTER (WHERE back AND {0}) / NULLIF(COUNT(*) FILTER (WHERE {0}), 0)"
    return with_ev(f"""SELECT name AS event_name, COUNT(*) FILTER (WHERE has) AS did_event_users,
       COUNT(*) FILTER (WHERE NOT has) AS no_event_users,
       CAST({rate.format("has")} AS DOUBLE) AS d7_retention_with_event,
       CAST({rate.format("NOT has")} AS DOUBLE) AS d7_retention_without_event,
       CAST({rate.format("has")} - {rate.format("NOT has")} AS DOUBLE) AS lift
FROM grid WHERE name IS NOT NULL GROUP BY name
HAVING did_event_users >= {min_users} AND no_event_users >= {min_users}
ORDER BY lift DESC NULLS LAST, event_name LIMIT {limit}""", facts)


def retention_correlation() -> str:
    return rounded(correlation_sql(fx.START, fx.END, 50),
                   ["d7_retention_with_event", "d7_retention_without_event", "lift"])


def volume_sql(this, last, min_users: int, limit: int, prev_name: str = "last_users") -> str:
    """Distinct users of an event in both periods, by the size of the relative change."""
    def users(rng):
        return f"COUNT(DISTINCT user_pseudo_id) FILTER (WHERE {between(*rng)})"

    return with_ev(f"""SELECT event_name, {users(this)} AS this_users, {users(last)} AS {prev_name},
       CAST(({users(this)} - {users(last)}) / NULLIF({users(last)}, 0) AS DOUBLE) AS pct_change
FROM ev WHERE event_name IS NOT NULL AND ({between(*this)} OR {between(*last)})
GROUP BY event_name HAVING {users(last)} >= {min_users}
ORDER BY ABS(COALESCE(pct_change, 0)) DESC, event_name LIMIT {limit}""")


def event_volume_change() -> str:
    return rounded(volume_sql(fx.THIS_WEEK, fx.LAST_WEEK, 50, 10), ["pct_change"])


def adjacent_movers() -> str:
    return rounded(volume_sql(fx.HALF_B, fx.HALF_A, 30, 8, "prev_users"), ["pct_change"])


def explain_context() -> str:
    top = top_events_sql(fx.HALF_B[0], fx.HALF_B[1], 10)
    movers = volume_sql(fx.HALF_B, fx.HALF_A, 30, 8, "prev_users")
    return f"""SELECT 'top_events' AS section,
       CAST(ROW_NUMBER() OVER (ORDER BY event_count DESC, event_name) AS INTEGER) AS position,
       event_name, unique_users AS users, CAST(NULL AS BIGINT) AS this_users,
       CAST(NULL AS BIGINT) AS prev_users, CAST(NULL AS DOUBLE) AS pct_change
FROM ({top}) AS t
UNION ALL
SELECT 'adjacent_movers',
       CAST(ROW_NUMBER() OVER (ORDER BY ABS(COALESCE(pct_change, 0)) DESC, event_name) AS INTEGER),
       event_name, CAST(NULL AS BIGINT), this_users, prev_users, ROUND(COALESCE(pct_change, 0), 6)
FROM ({movers}) AS m"""


# ---------------------------------------------------------------- step 8
INSIGHT_SELECT = "id, kind, ROUND(severity, 6) AS severity, title, detail, event, start_event, end_event"


def rule_conversion_sql(conv: str, label: str = "vs previous period", min_rel: float = 0.05, min_starts: int = 50,
                        metric: str = "") -> str:
    tr, lr = "COALESCE(this_rate, 0.0)", "COALESCE(last_rate, 0.0)"
    rel = f"(({tr} - {lr}) / {lr})"
    return f"""SELECT 'conv_change_signup_purchase' AS id, 'conversion' AS kind,
       LEAST(1.0, ABS({rel}) * 2) AS severity,
       'signup → purchase conversion ' || CASE WHEN {tr} - {lr} < 0 THEN 'dropped' ELSE 'increased' END
         || ' ' || {pct_sql(f'ABS({rel})')} || ' {label}' AS title,
       'This period: ' || {pct_sql(tr)} || ' (' || this_finishes || ' of ' || this_starts || ' users). Previous: '
         || {pct_sql(lr)} || ' (' || last_finishes || ' of ' || last_starts || ').' AS detail,
       CAST(NULL AS VARCHAR) AS event, 'signup' AS start_event, 'purchase' AS end_event, 1 AS pos{metric}
FROM ({conv}) AS c
WHERE {lr} <> 0 AND ABS({rel}) >= {min_rel} AND COALESCE(this_starts, 0) >= {min_starts}"""


def rule_funnel_sql(steps_sql: str) -> str:
    d = "drop_off_from_prev_pct"
    return f"""SELECT 'funnel_drop_' || event AS id, 'funnel' AS kind, LEAST(1.0, {d}) AS severity,
       'Biggest drop-off is at "' || event || '" (' || {pct_sql(d)} || ')' AS title,
       'Only ' || users || ' of the previous step''s users continued to ' || event
         || '. This is the single biggest leak in the funnel.' AS detail,
       event, CAST(NULL AS VARCHAR) AS start_event, CAST(NULL AS VARCHAR) AS end_event, 1 AS pos
FROM (SELECT * FROM ({steps_sql}) AS s WHERE step_index > 1 AND {d} IS NOT NULL
      QUALIFY ROW_NUMBER() OVER (ORDER BY {d} DESC, step_index) = 1) AS w
WHERE {d} >= 0.3"""


def rule_retention_sql(corr: str, min_lift: float = 0.1, metric: str = "") -> str:
    w, wo = "COALESCE(d7_retention_with_event, 0.0)", "COALESCE(d7_retention_without_event, 0.0)"
    lift = f"({w} - {wo})"
    pp = f"printf('%.1f', round({lift} * 100, 1))"
    return f"""SELECT 'ret_corr_' || event_name AS id, 'retention' AS kind, LEAST(1.0, {lift} * 2) AS severity,
       'Users who do "' || event_name || '" on day 1 retain ' || {pp} || 'pp better at D7' AS title,
       'D7 retention with event: ' || {pct_sql(w)} || ' (' || did_event_users || ' users). Without: '
         || {pct_sql(wo)} || ' (' || no_event_users || ' users). Lift: +' || {pp} || ' percentage points.' AS detail,
       event_name AS event, CAST(NULL AS VARCHAR) AS start_event, CAST(NULL AS VARCHAR) AS end_event, pos{metric}
FROM (SELECT *, ROW_NUMBER() OVER (ORDER BY lift DESC NULLS LAST, event_name) AS pos FROM ({corr}) AS c
      QUALIFY pos <= 3) AS t
WHERE {lift} >= {min_lift}"""


def rule_volume_sql(vol: str, label: str = "this period", min_rel: float = 0.25, metric: str = "") -> str:
    rel = "COALESCE(pct_change, 0.0)"
    return f"""SELECT 'vol_' || event_name AS id, 'volume' AS kind, LEAST(1.0, ABS({rel})) AS severity,
       '"' || event_name || '" ' || CASE WHEN {rel} > 0 THEN 'spiked' ELSE 'dropped' END || ' '
         || {pct_sql(f'ABS({rel})')} || ' {label}' AS title,
       'This period: ' || this_users || ' users. Previous: ' || last_users || ' users.' AS detail,
       event_name AS event, CAST(NULL AS VARCHAR) AS start_event, CAST(NULL AS VARCHAR) AS end_event, pos{metric}
FROM (SELECT *, ROW_NUMBER() OVER (ORDER BY ABS({rel}) DESC, event_name) AS pos FROM ({vol}) AS v
      QUALIFY pos <= 3) AS t
WHERE ABS({rel}) >= {min_rel}"""


def insight_conversion() -> str:
    return f"SELECT {INSIGHT_SELECT} FROM ({rule_conversion_sql(conversion_sql(fx.HALF_B, fx.HALF_A, 7))}) AS r"


def insight_funnel_drop() -> str:
    steps = funnel_sql(fx.FUNNEL_STEPS, fx.START, fx.END, fx.WINDOW_DAYS, round_result=False)
    return f"SELECT {INSIGHT_SELECT} FROM ({rule_funnel_sql(steps)}) AS r"


def insight_retention() -> str:
    return f"SELECT {INSIGHT_SELECT} FROM ({rule_retention_sql(correlation_sql(fx.START, fx.END, 50))}) AS r"


def insight_volume() -> str:
    return f"SELECT {INSIGHT_SELECT} FROM ({rule_volume_sql(volume_sql(fx.THIS_WEEK, fx.LAST_WEEK, 50, 10))}) AS r"


def _metric_sql(cols: dict[str, str]) -> str:
    return "".join(f", ROUND(CAST({c} AS DOUBLE), 6) AS metric_{n}" for n, c in cols.items())


def insight_conversion_any() -> str:
    tr, lr = "COALESCE(this_rate, 0.0)", "COALESCE(last_rate, 0.0)"
    cols = {"this_rate": tr, "last_rate": lr, "rel_change": f"({tr} - {lr}) / {lr}", "this_starts": "this_starts",
            "this_finishes": "this_finishes"}
    rows = rule_conversion_sql(conversion_sql(fx.THIS_WEEK, fx.LAST_WEEK, 7), min_rel=0.0, min_starts=0, metric=_metric_sql(cols))
    return f"SELECT {INSIGHT_SELECT}, {', '.join(f'metric_{n}' for n in cols)} FROM ({rows}) AS r"


def insight_retention_any() -> str:
    w, wo = "COALESCE(d7_retention_with_event, 0.0)", "COALESCE(d7_retention_without_event, 0.0)"
    cols = {"d7_with": w, "d7_without": wo, "lift": f"{w} - {wo}"}
    rows = rule_retention_sql(correlation_sql(fx.START, fx.END, 50), -1.0, _metric_sql(cols))
    return f"SELECT {INSIGHT_SELECT}, {', '.join(f'metric_{n}' for n in cols)} FROM ({rows}) AS r"


def insight_volume_any() -> str:
    cols = {"this": "this_users", "last": "last_users", "rel_change": "COALESCE(pct_change, 0.0)"}
    rows = rule_volume_sql(volume_sql(fx.THIS_WEEK, fx.LAST_WEEK, 50, 10), min_rel=0.0, metric=_metric_sql(cols))
    return f"SELECT {INSIGHT_SELECT}, {', '.join(f'metric_{n}' for n in cols)} FROM ({rows}) AS r"


def ranked_sql(parts: list[str]) -> str:
    union = "\nUNION ALL\n".join(f"SELECT {i} AS rule_no, * FROM ({p}) AS p{i}" for i, p in enumerate(parts))
    return f"""SELECT CAST(ROW_NUMBER() OVER (ORDER BY severity DESC, rule_no, pos, id) AS INTEGER) AS rank, {INSIGHT_SELECT}
FROM ({union}) AS u"""


def funnel_part() -> str:
    return rule_funnel_sql(funnel_sql(fx.FUNNEL_STEPS, fx.START, fx.END, fx.WINDOW_DAYS, round_result=False))


def insights_ranked() -> str:
    return ranked_sql([
        rule_volume_sql(volume_sql(fx.HALF_B, fx.HALF_A, 50, 10)),
        rule_retention_sql(correlation_sql(fx.HALF_B[0], fx.HALF_B[1], 50)),
        rule_conversion_sql(conversion_sql(fx.HALF_B, fx.HALF_A, 7)), funnel_part()])


def insights_weekly() -> str:
    # the week of 24 January against that of 17 January; the correlation begins 31 days before 31 January
    this, last = ("20240124", "20240130"), ("20240117", "20240123")
    return ranked_sql([
        rule_volume_sql(volume_sql(this, last, 50, 10), "this week", 0.0),
        rule_retention_sql(correlation_sql("20231231", "20240130", 50), -1.0),
        rule_conversion_sql(conversion_sql(this, last, 7), "vs last week", 0.0), funnel_part()])


def insights_own_rules() -> str:
    seen = f"""SELECT DISTINCT user_pseudo_id AS u, {between(*fx.HALF_B)} AS now
  FROM ev WHERE user_pseudo_id IS NOT NULL AND {between(fx.HALF_A[0], fx.HALF_B[1])}"""
    null = "CAST(NULL AS VARCHAR)"
    lapsed = with_ev(f"""SELECT 'lapsed_users' AS id, 'volume' AS kind, gone / users AS severity,
       {pct_sql('gone / users')} || ' of users did not return' AS title, gone || ' of ' || users || ' users.' AS detail,
       {null} AS event, {null} AS start_event, {null} AS end_event, 1 AS pos
FROM (SELECT COUNT(*) AS users, COUNT(*) FILTER (NOT EXISTS (SELECT 1 FROM seen AS s WHERE s.now AND s.u = b.u)) AS gone
      FROM (SELECT DISTINCT u FROM seen WHERE NOT now) AS b) AS t WHERE users > 0""", f"seen AS ({seen})")
    quiet = with_ev(f"""SELECT 'quiet_' || e AS id, 'volume' AS kind, (prev - this) / prev AS severity,
       'Less of "' || e || '"' AS title, this || ' after ' || prev || '.' AS detail,
       e AS event, {null} AS start_event, {null} AS end_event, ROW_NUMBER() OVER (ORDER BY (prev - this) / prev DESC, e) AS pos
FROM (SELECT event_name AS e, COUNT(*) FILTER ({between(*fx.HALF_B)}) AS this, COUNT(*) FILTER ({between(*fx.HALF_A)}) AS prev
      FROM ev WHERE event_name IS NOT NULL GROUP BY event_name) AS t WHERE this < prev""")
    return ranked_sql([
        rule_volume_sql(volume_sql(fx.HALF_B, fx.HALF_A, 50, 10)),
        rule_retention_sql(correlation_sql(fx.HALF_B[0], fx.HALF_B[1], 50)),
        rule_conversion_sql(conversion_sql(fx.HALF_B, fx.HALF_A, 7)), lapsed, quiet])


# ---------------------------------------------------------------- step 9
def investigate_where() -> str:
    axes = [("country", "country"), ("platform", "platform"), ("app version", "app_version"),
            ("device category", "device_category")]
    parts = "\nUNION ALL\n".join(
        f"""SELECT * FROM (SELECT {q(label)} AS axis, {col} AS value, COUNT(DISTINCT user_pseudo_id) AS users
  FROM base GROUP BY value HAVING value IS NOT NULL AND value <> ''
  ORDER BY users DESC, value LIMIT 5) AS a{i}""" for i, (label, col) in enumerate(axes))
    ctes = f"""base AS (
  SELECT * FROM ev WHERE {between(*fx.HALF_B)} AND event_name = 'purchase' AND device_category = 'desktop'
),
total AS (SELECT COUNT(DISTINCT user_pseudo_id) AS total_users FROM base),
ax AS ({parts}),
ranked AS (
  SELECT axis, CAST(ROW_NUMBER() OVER (PARTITION BY axis ORDER BY users DESC, value) AS INTEGER) AS rank,
         value, users, users / total_users AS share, total_users
  FROM ax, total WHERE total_users > 0
)"""
    body = """SELECT axis, rank, value, users, ROUND(share, 6) AS share, (rank = 1 AND share >= 0.6) AS concentrated,
       total_users AS total_affected_users FROM ranked"""
    return with_ev(body, ctes)


def investigate_insights() -> str:
    """Axis shares and change day of every insight's target, insight by insight."""
    fired = "\nUNION ALL\n".join(f"SELECT id, event, end_event FROM ({p}) AS p{i}" for i, p in enumerate([
        rule_volume_sql(volume_sql(fx.HALF_B, fx.HALF_A, 50, 10), min_rel=0.0),
        rule_conversion_sql(conversion_sql(fx.HALF_B, fx.HALF_A, 7), min_rel=0.0)]))
    axes = [("country", "country"), ("platform", "platform"), ("app version", "app_version"),
            ("device category", "device_category")]
    parts = "\nUNION ALL\n".join(
        f"SELECT insight_id, {q(label)} AS axis, {col} AS value, COUNT(DISTINCT user_pseudo_id) AS users FROM base "
        f"WHERE {col} <> '' GROUP BY ALL" for label, col in axes)
    ctes = f"""fired AS ({fired}),
tg AS (SELECT id AS insight_id, COALESCE(event, end_event, 'session_start') AS target FROM fired),
around AS (SELECT * FROM ev WHERE {between(fx.START, fx.END)} AND device_category = 'desktop'),
base AS (SELECT insight_id, around.* FROM around JOIN tg ON event_name = target WHERE {between(*fx.HALF_B)}),
total AS (SELECT insight_id, COUNT(DISTINCT user_pseudo_id) AS total_users FROM base GROUP BY ALL),
top AS (SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY insight_id, axis ORDER BY users DESC, value) AS INTEGER) AS rank
        FROM ({parts}) AS a),
tl AS (SELECT insight_id, event_date, COUNT(*) FILTER (WHERE event_name = target) AS n FROM around, tg GROUP BY ALL),
b AS (SELECT insight_id, CASE WHEN COUNT(*) FILTER (WHERE event_date >= {q(fx.HALF_B[0])}) > 0 THEN
             COALESCE(NULLIF(AVG(n) FILTER (WHERE event_date < {q(fx.HALF_B[0])}), 0), CASE WHEN COUNT(*) FILTER
             (WHERE event_date < {q(fx.HALF_B[0])}) > 0 THEN 1.0 END) END AS baseline FROM tl GROUP BY ALL)"""
    body = """SELECT insight_id, target, 'where' AS section, axis, rank, value, users, ROUND(users / total_users, 6) AS share,
       rank = 1 AND users / total_users >= 0.6 AS concentrated, total_users AS total_affected_users,
       CAST(NULL AS DOUBLE) AS baseline, CAST(NULL AS VARCHAR) AS change_started_on
FROM top JOIN total USING (insight_id) JOIN tg USING (insight_id) WHERE rank <= 5
UNION ALL
SELECT insight_id, target, 'when', NULL, NULL, NULL, NULL, NULL, NULL, NULL, ROUND(CAST(baseline AS DOUBLE), 6),
       (SELECT CAST(CAST(strptime(MIN(event_date), '%Y%m%d') AS DATE) AS VARCHAR) FROM tl
        WHERE tl.insight_id = b.insight_id AND event_date >= '""" + fx.HALF_B[0] + """'
          AND ABS(n - baseline) / GREATEST(baseline, 1) >= 0.25)
FROM b JOIN tg USING (insight_id)"""
    return with_ev(body, ctes)


def event_sample() -> str:
    return with_ev(f"""SELECT event_name, COUNT(*) AS n, COUNT(DISTINCT user_pseudo_id) AS users
FROM (SELECT * FROM ev WHERE event_date = {q(fx.END)}
      ORDER BY md5(concat(event_timestamp, ' ', COALESCE(user_pseudo_id, ''), ' ', COALESCE(event_name, ''))) LIMIT 500) AS s
GROUP BY event_name""")


def timeline_sql() -> str:
    return with_ev(f"""SELECT CAST(CAST(strptime(event_date, '%Y%m%d') AS DATE) AS VARCHAR) AS date,
       COUNT(DISTINCT user_pseudo_id) AS dau,
       COUNT(CASE WHEN event_name = 'purchase' THEN 1 END) AS target_count
FROM ev WHERE {between(fx.START, fx.END)} AND device_category = 'desktop'
GROUP BY date ORDER BY date""")


def investigate_when() -> str:
    return timeline_sql()


def investigate_change_day() -> str:
    return f"""WITH tl AS ({timeline_sql()}),
b AS (SELECT AVG(CASE WHEN date < '2024-01-16' THEN target_count END) AS m,
             COUNT(CASE WHEN date >= '2024-01-16' THEN 1 END) AS n_after FROM tl),
bb AS (SELECT CASE WHEN n_after > 0 THEN CASE WHEN m = 0 THEN 1.0 ELSE m END END AS baseline FROM b)
SELECT '20240101' AS baseline_start, '20240116' AS analysis_start, '20240130' AS analysis_end,
       ROUND(CAST(baseline AS DOUBLE), 6) AS baseline,
       (SELECT MIN(date) FROM tl WHERE date >= '2024-01-16'
          AND ABS(target_count - bb.baseline) / GREATEST(bb.baseline, 1) >= 0.25) AS change_started_on
FROM bb"""


# ---------------------------------------------------------------- step 10
def kpi_period_sql(period: str, s: str, e: str, cohort_where: str | None) -> str:
    join = ""
    cte = ""
    if cohort_where:
        cte = (f"cu AS (SELECT DISTINCT user_pseudo_id FROM ev WHERE {between(s, e)} AND ({cohort_where}))")
        join = "JOIN cu USING (user_pseudo_id)"
    head = headline_sql(retention_sql(s, e, cohort_where))
    body = f"""SELECT {q(period)} AS period, {q(s)} AS period_start, {q(e)} AS period_end,
  (SELECT COUNT(DISTINCT x.user_pseudo_id) FROM ev x {join} WHERE {between(s, e, 'x.event_date')}) AS active_users,
  (SELECT COUNT(*) FROM ev x {join} WHERE {between(s, e, 'x.event_date')}) AS total_events,
  h.d7_avg AS d7_rate, h.d7_retained, h.total_users AS total_cohorted
FROM ({head}) AS h"""
    return with_ev(body, cte)


def dashboard_sql(cohort_where: str | None) -> str:
    return (f"SELECT * REPLACE (ROUND(d7_rate, 6) AS d7_rate) FROM ("
            f"SELECT * FROM ({kpi_period_sql('current', *fx.HALF_B, cohort_where)}) AS c\nUNION ALL\n"
            f"SELECT * FROM ({kpi_period_sql('previous', *fx.HALF_A, cohort_where)}) AS p) AS k")


def dashboard_kpis() -> str:
    return dashboard_sql("platform IN ('IOS', 'ANDROID')")


def kpi_deltas() -> str:
    raw = (f"SELECT * FROM ({kpi_period_sql('current', *fx.HALF_B, None)}) AS c\nUNION ALL\n"
           f"SELECT * FROM ({kpi_period_sql('previous', *fx.HALF_A, None)}) AS p")

    def count_row(k):
        c, p = f"c_{k}", f"p_{k}"
        pct = f"CAST({c} - {p} AS DOUBLE) / {p} * 100"
        return f"""SELECT '{k}' AS kpi, CAST({c} AS DOUBLE) AS current_value, CAST({p} AS DOUBLE) AS previous_value,
  CAST(CASE WHEN {c} IS NULL OR {p} IS NULL THEN NULL WHEN {p} = 0 THEN CASE WHEN {c} = 0 THEN 0.0 END
       ELSE round_even({pct}, 1) END AS DOUBLE) AS pct,
  CAST(NULL AS DOUBLE) AS pp,
  CASE WHEN {c} IS NULL OR {p} IS NULL THEN NULL WHEN {p} = 0 THEN CASE WHEN {c} = 0 THEN 'flat' ELSE 'up' END
       WHEN {pct} > 0.5 THEN 'up' WHEN {pct} < -0.5 THEN 'down' ELSE 'flat' END AS direction,
  CAST({c} - {p} AS BIGINT) AS absolute
FROM w"""
    pp = "(c_d7_rate - p_d7_rate) * 100"
    d7 = f"""SELECT 'd7_rate', c_d7_rate, p_d7_rate, CAST(NULL AS DOUBLE),
  round_even({pp}, 1),
  CASE WHEN c_d7_rate IS NULL OR p_d7_rate IS NULL THEN NULL WHEN {pp} > 0.05 THEN 'up'
       WHEN {pp} < -0.05 THEN 'down' ELSE 'flat' END,
  CAST(NULL AS BIGINT)
FROM w"""
    return f"""WITH k AS ({raw}),
w AS (SELECT
  MAX(CASE WHEN period = 'current' THEN active_users END) AS c_active_users,
  MAX(CASE WHEN period = 'previous' THEN active_users END) AS p_active_users,
  MAX(CASE WHEN period = 'current' THEN total_events END) AS c_total_events,
  MAX(CASE WHEN period = 'previous' THEN total_events END) AS p_total_events,
  MAX(CASE WHEN period = 'current' THEN d7_rate END) AS c_d7_rate,
  MAX(CASE WHEN period = 'previous' THEN d7_rate END) AS p_d7_rate
FROM k)
SELECT * REPLACE (ROUND(current_value, 6) AS current_value, ROUND(previous_value, 6) AS previous_value,
                  ROUND(pct, 6) AS pct, ROUND(pp, 6) AS pp)
FROM ({count_row('active_users')} UNION ALL {count_row('total_events')} UNION ALL {d7}) AS r"""


def growth_check() -> str:
    return f"""WITH daily AS ({daily_activity_sql(fx.START, fx.END)}),
d AS (SELECT dau, ROW_NUMBER() OVER (ORDER BY day) AS a, ROW_NUMBER() OVER (ORDER BY day DESC) AS dd FROM daily),
agg AS (SELECT COUNT(*) AS days, SUM(CASE WHEN a <= 7 THEN dau END) / 7 AS fw,
               SUM(CASE WHEN dd <= 7 THEN dau END) / 7 AS lw FROM d)
SELECT days,
  ROUND(CAST(CASE WHEN days >= 14 THEN fw END AS DOUBLE), 6) AS first_week_avg,
  ROUND(CAST(CASE WHEN days >= 14 THEN lw END AS DOUBLE), 6) AS last_week_avg,
  ROUND(CAST(CASE WHEN days >= 14 THEN CASE WHEN fw <> 0 THEN (lw - fw) / fw ELSE 0.0 END END AS DOUBLE), 6)
    AS rel_change,
  CASE WHEN days >= 14 THEN CASE WHEN (CASE WHEN fw <> 0 THEN (lw - fw) / fw ELSE 0.0 END) >= 0
       THEN 'up' ELSE 'down' END END AS direction
FROM agg"""


def freshness_status() -> str:
    return f"""WITH f AS ({freshness()}),
g AS (SELECT *, round_even((epoch_us(TIMESTAMP '2024-01-31 00:00:00') - latest_event) / {HOUR_US}, 1) AS h FROM f)
SELECT CASE WHEN latest_event IS NULL THEN 'no_data' WHEN h < 30 THEN 'fresh' WHEN h < 72 THEN 'stale'
            ELSE 'broken' END AS status,
       latest_event, ROUND(CAST(h AS DOUBLE), 6) AS hours_old, days_with_data
FROM g"""


def relative_share() -> str:
    return f"""SELECT *, ROUND(unique_users / MAX(unique_users) OVER () * 100, 6) AS bar_pct
FROM ({top_events_sql(fx.START, fx.END, 50)}) AS t"""


# ---------------------------------------------------------------- step 11
JOURNEY_COLS = """event_timestamp AS event_time, event_name, platform, CAST(NULL AS VARCHAR) AS page_title,
       screen_name, engagement_msec, session_id, country, device_category, CAST(NULL AS VARCHAR) AS os,
       app_version"""


def journey_order(direction: str) -> str:
    cols = ("event_timestamp", "event_name", "platform", "screen_name", "engagement_msec", "session_id", "country",
            "device_category", "app_version")
    return ", ".join(f"{c} {direction}" for c in cols)


def user_journey() -> str:
    return with_ev(f"""SELECT user_pseudo_id, CAST(a AS INTEGER) AS seq, * EXCLUDE (user_pseudo_id, a)
FROM (
  SELECT user_pseudo_id, {JOURNEY_COLS},
    ROW_NUMBER() OVER (PARTITION BY user_pseudo_id ORDER BY {journey_order('ASC NULLS FIRST')}) AS a
  FROM ev WHERE {between(fx.START, fx.END)} AND user_pseudo_id IS NOT NULL
) AS r""")


def journey_sample() -> str:
    return with_ev(f"""SELECT user_pseudo_id, seq, event_time, event_name, platform, page_title, screen_name,
       engagement_msec, session_id, country, device_category, os, app_version
FROM (
  SELECT user_pseudo_id, CAST(a AS INTEGER) AS seq, * EXCLUDE (user_pseudo_id, a, d) FROM r WHERE a <= 8
  UNION ALL
  SELECT user_pseudo_id, CAST(-d AS INTEGER) AS seq, * EXCLUDE (user_pseudo_id, a, d) FROM r WHERE d <= 4
) AS u""", f"""r AS (
  SELECT user_pseudo_id, {JOURNEY_COLS},
    ROW_NUMBER() OVER (PARTITION BY user_pseudo_id ORDER BY {journey_order('ASC NULLS FIRST')}) AS a,
    ROW_NUMBER() OVER (PARTITION BY user_pseudo_id ORDER BY {journey_order('DESC NULLS LAST')}) AS d
  FROM ev WHERE {between(fx.START, fx.END)} AND user_pseudo_id IS NOT NULL
)""")


def minutes_sql(ms: str) -> str:
    qq, r = f"(({ms}) // 6000)", f"(({ms}) % 6000)"
    return (f"(CASE WHEN {r} > 3000 THEN {qq} + 1 WHEN {r} < 3000 THEN {qq} "
            f"ELSE {qq} + ({qq} % 2) END) / 10.0")


def totals_cte(span: tuple[str, str] = (fx.START, fx.END)) -> str:
    return f"""tot AS (
  SELECT user_pseudo_id, COUNT(*) AS event_count, COUNT(DISTINCT session_id) AS session_count,
    COUNT(DISTINCT uday) AS active_days, MIN(event_timestamp) AS first_seen, MAX(event_timestamp) AS last_seen,
    CAST({minutes_sql('SUM(COALESCE(engagement_msec, 0))')} AS DOUBLE) AS total_engagement_minutes,
    MAX(uday) - MIN(uday) AS lifespan_days,
    MIN(CASE WHEN country <> '' THEN country END) AS country,
    (array_agg(app_version ORDER BY event_timestamp, app_version))[1] AS app_version,
    string_agg(DISTINCT platform, ',' ORDER BY platform) AS platforms
  FROM ev WHERE {between(*span)} AND user_pseudo_id IS NOT NULL
  GROUP BY user_pseudo_id
)"""


def top_cte(k: int | None = 8, span: tuple[str, str] = (fx.START, fx.END)) -> str:
    most = f"WHERE rank <= {k}" if k else ""
    return f"""topev AS (
  SELECT * FROM (
    SELECT user_pseudo_id, event_name AS event, COUNT(*) AS event_count,
      CAST(ROW_NUMBER() OVER (PARTITION BY user_pseudo_id
                              ORDER BY COUNT(*) DESC, MIN(event_timestamp), event_name) AS INTEGER) AS rank
    FROM ev WHERE {between(*span)} AND user_pseudo_id IS NOT NULL AND event_name IS NOT NULL
    GROUP BY user_pseudo_id, event_name
  ) AS x {most}
)"""


def user_totals() -> str:
    return with_ev("""SELECT user_pseudo_id, event_count, session_count, active_days, first_seen, last_seen,
       total_engagement_minutes FROM tot""", totals_cte())


def user_top_events() -> str:
    return with_ev("SELECT user_pseudo_id, rank, event, event_count FROM topev", top_cte())


def metrics_cte(span: tuple[str, str] = (fx.START, fx.END)) -> str:
    return totals_cte(span) + ",\n" + top_cte(span=span) + """,
m AS (
  SELECT t.user_pseudo_id, event_count, session_count, total_engagement_minutes, first_seen, last_seen,
    active_days, CAST(lifespan_days AS INTEGER) AS lifespan_days, country, app_version,
    (SELECT string_agg(x.event || ':' || x.event_count, '|' ORDER BY x.rank) FROM topev x
      WHERE x.user_pseudo_id = t.user_pseudo_id) AS top_events,
    (SELECT x.event FROM topev x WHERE x.user_pseudo_id = t.user_pseudo_id AND x.rank = 1) AS top_event,
    platforms
  FROM tot t
)"""


def user_metrics() -> str:
    return with_ev("SELECT * EXCLUDE (top_event) FROM m", metrics_cte())


def pattern_sql(as_of: str = "2024-01-31") -> str:
    as_of_us = f"epoch_us(TIMESTAMP '{as_of} 00:00:00')"
    since = f"(({as_of_us} - last_seen) // {DAY_US})"
    return f"""CASE WHEN COALESCE(event_count, 0) = 0 THEN 'no_data'
  WHEN session_count <= 1 AND event_count < 10 THEN 'one_and_done'
  WHEN session_count >= 10 AND active_days >= 7 THEN 'power_user'
  WHEN lifespan_days >= 5 AND {since} > lifespan_days * 0.5 THEN 'drifted_off'
  WHEN session_count >= 3 AND active_days >= 3 THEN 'returning_visitor'
  ELSE 'casual' END"""


def user_patterns() -> str:
    from evlens.operators.users import PATTERNS
    conf = " ".join(f"WHEN {q(k)} THEN {c}" for k, (c, _) in PATTERNS.items())
    desc = " ".join(f"WHEN {q(k)} THEN {q(d)}" for k, (_, d) in PATTERNS.items())
    return with_ev(f"""SELECT user_pseudo_id, label, CAST(CASE label {conf} END AS DOUBLE) AS confidence,
       CASE label {desc} END AS description
FROM (SELECT *, {pattern_sql()} AS label FROM m) AS p""", metrics_cte())


def user_narrative(span: tuple[str, str] = (fx.START, fx.END), as_of: str = "2024-01-31") -> str:
    from evlens.operators.users import NO_DATA_TEXT, PATTERN_TEXT
    texts = " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in PATTERN_TEXT.items())
    story = ("printf('**Story**: This user generated %d events across %d session(s) over %d active day(s) "
             "(lifespan: %d days). Most frequent action: %s.', event_count, session_count, active_days, "
             "lifespan_days, COALESCE(top_event, 'no events')) || chr(10) || chr(10)")
    return with_ev(f"""SELECT user_pseudo_id, label,
  CASE WHEN label = 'no_data' THEN {q(NO_DATA_TEXT)} ELSE {story} || CASE label {texts} END END AS narrative
FROM (SELECT *, {pattern_sql(as_of)} AS label FROM m) AS p""", metrics_cte(span))


def user_narrative_trailing() -> str:
    last = 25       # of January 2024
    return "\nUNION ALL\n".join(
        f"SELECT {n} AS days, * FROM ({user_narrative((f'202401{last - n + 1:02d}', f'202401{last}'), '2024-01-30')}) AS w{n}"
        for n in (1, 3, 10))


def user_focus() -> str:
    from evlens.operators.users import FOCUS_BUCKETS
    case = "CASE " + " ".join(
        "WHEN " + " OR ".join(f"lower(event) LIKE '%{w}%'" for w in words) + f" THEN {q(label)}"
        for label, words in FOCUS_BUCKETS) + " END"
    sums = ", ".join(f"SUM(CASE WHEN bucket = {q(lbl)} THEN event_count ELSE 0 END) AS b{i}"
                     for i, (lbl, _) in enumerate(FOCUS_BUCKETS))
    cat = " + ".join(f"b{i}" for i in range(len(FOCUS_BUCKETS)))
    rows = "\nUNION ALL\n".join(
        f"SELECT user_pseudo_id, {i} AS ord, {q(lbl)} AS label, "
        f"CAST(CASE WHEN base > 0 THEN floor(b{i} / base * 100 + 0.5) ELSE 0 END AS INTEGER) AS pct FROM per"
        for i, (lbl, _) in enumerate(FOCUS_BUCKETS))
    ctes = top_cte(None) + f""",
per0 AS (SELECT user_pseudo_id, {sums}, SUM(event_count) AS total
         FROM (SELECT *, {case} AS bucket FROM topev) AS t GROUP BY user_pseudo_id),
per AS (SELECT *, CASE WHEN {cat} > 0 THEN {cat} ELSE total END AS base FROM per0),
rowsx AS ({rows})"""
    return with_ev("""SELECT user_pseudo_id,
  CAST(ROW_NUMBER() OVER (PARTITION BY user_pseudo_id ORDER BY pct DESC, ord) AS INTEGER) AS position, label, pct
FROM rowsx QUALIFY MAX(pct) OVER (PARTITION BY user_pseudo_id) > 0""", ctes)


# ---------------------------------------------------------------- step 12 / 13
def phrases_sql(phrases: dict, hints: list, columns: str, rows: str) -> str:
    off = " OR ".join(f"contains(lower(text), {q(h)})" for h in hints)
    # Literal form: per intent, the longest matching phrase length; the intent with
    # the largest one wins, earlier intents on ties.
    lens = ",\n  ".join(
        "GREATEST(" + ", ".join(f"CASE WHEN contains(lower(text), {q(p)}) THEN {len(p)} ELSE 0 END" for p in ps)
        + f") AS l{i}" for i, ps in enumerate(phrases.values()))
    names = list(phrases)
    n = len(names)
    best = "GREATEST(" + ", ".join(f"l{i}" for i in range(n)) + ")"
    pick = " ".join(f"WHEN l{i} = best THEN {q(names[i])}" for i in range(n))
    return f"""SELECT {columns},
  CASE WHEN off THEN 'off_topic' WHEN best = 0 THEN 'unknown' ELSE CASE {pick} END END AS intent
FROM (SELECT *, {best} AS best FROM (
  SELECT {columns}, ({off}) AS off,
  {lens}
  FROM {rows}) AS a) AS b"""


def intent_tags() -> str:
    from evlens.operators.intents import KEYWORD_PHRASES, OFF_TOPIC_HINTS
    return phrases_sql(KEYWORD_PHRASES, OFF_TOPIC_HINTS, "conv_id, turn", "conversations WHERE role = 'user'")


def phrase_tags() -> str:
    from evlens.plans.catalog import OWN_HINTS, OWN_PHRASES
    return phrases_sql(OWN_PHRASES, OWN_HINTS, "conv_id, turn, role", "conversations")


def daily_activity_stream() -> str:
    return daily_activity_sql(fx.START, fx.END)


def affected_users() -> str:
    return with_ev(f"""SELECT COUNT(DISTINCT user_pseudo_id) AS total_users FROM ev
WHERE {between(*fx.HALF_B)} AND event_name = 'purchase' AND device_category = 'desktop'""")


def dashboard_overview() -> str:
    cur = kpi_period_sql("current", *fx.HALF_B, None)
    prev = kpi_period_sql("previous", *fx.HALF_A, None)
    top = top_events_sql(fx.HALF_B[0], fx.HALF_B[1], 5)
    dau = daily_activity_sql(*fx.HALF_B)

    def pct(k):
        c, p = f"k.{k}", f"p.{k}"
        v = f"CAST({c} - {p} AS DOUBLE) / {p} * 100"
        return (f"CAST(CASE WHEN {c} IS NULL OR {p} IS NULL THEN NULL WHEN {p} = 0 THEN CASE WHEN {c} = 0 THEN 0.0 END "
                f"ELSE round_even({v}, 1) END AS DOUBLE) AS {k}_pct, "
                f"CASE WHEN {c} IS NULL OR {p} IS NULL THEN NULL WHEN {p} = 0 THEN CASE WHEN {c} = 0 THEN 'flat' "
                f"ELSE 'up' END WHEN {v} > 0.5 THEN 'up' WHEN {v} < -0.5 THEN 'down' ELSE 'flat' END AS {k}_direction")
    pp = "(k.d7_rate - p.d7_rate) * 100"
    return f"""SELECT k.period_start, k.period_end, k.active_users, k.total_events, ROUND(k.d7_rate, 6) AS d7_rate,
       k.d7_retained, k.total_cohorted,
       (SELECT string_agg(event_name || ':' || event_count || ':' || unique_users, '|'
                          ORDER BY event_count DESC, event_name) FROM ({top}) AS t) AS top_events,
       (SELECT string_agg(day || ':' || dau, '|' ORDER BY day) FROM ({dau}) AS d) AS sparkline,
       p.period_start AS prev_period_start, p.period_end AS prev_period_end, p.active_users AS prev_active_users,
       p.total_events AS prev_total_events, ROUND(p.d7_rate, 6) AS prev_d7_rate,
       {pct('active_users')}, {pct('total_events')},
       ROUND(round_even({pp}, 1), 6) AS d7_pp,
       CASE WHEN {pp} > 0.05 THEN 'up' WHEN {pp} < -0.05 THEN 'down' ELSE 'flat' END AS d7_direction
FROM ({cur}) AS k, ({prev}) AS p"""


ORACLES = {
    "canonical_events": canonical_events,
    "event_param_sample": event_param_sample,
    "funnel": funnel,
    "funnel_strict": funnel_strict,
    **{k: (lambda k=k: top_events_sql(fx.START, fx.END, 50, COHORT_SQL[k])) for k in COHORT_SQL},
    **{k: (lambda k=k: funnel_sql(fx.FUNNEL_STEPS, fx.START, fx.END, fx.WINDOW_DAYS,
                                  cohort_where=FUNNEL_COHORT_SQL[k])) for k in FUNNEL_COHORT_SQL},
    "cohort_row_level": cohort_row_level,
    "top_events": top_events,
    "top_events_cohort": top_events_cohort,
    "daily_activity": daily_activity,
    "active_users": active_users,
    "total_events": total_events,
    "recent_users": recent_users,
    "freshness": freshness,
    "field_discovery": field_discovery,
    "retention": retention,
    "retention_cohort": retention_cohort,
    "retention_headline": retention_headline,
    "retention_maturity": retention_maturity,
    "suggest_steps": suggest_steps,
    "breakdown_values": breakdown_values,
    "funnel_breakdown": funnel_breakdown,
    "retention_breakdown": retention_breakdown,
    "compare_cohorts": compare_cohorts,
    "conversion_change": conversion_change,
    "conversion_change_ordered": conversion_change_ordered,
    "retention_correlation": retention_correlation,
    "event_volume_change": event_volume_change,
    "adjacent_movers": adjacent_movers,
    "explain_context": explain_context,
    "insight_conversion": insight_conversion,
    "insight_funnel_drop": insight_funnel_drop,
    "insight_retention": insight_retention,
    "insight_volume": insight_volume,
    "insights_ranked": insights_ranked,
    "investigate_where": investigate_where,
    "investigate_when": investigate_when,
    "investigate_change_day": investigate_change_day,
    "dashboard_kpis": dashboard_kpis,
    "kpi_deltas": kpi_deltas,
    "growth_check": growth_check,
    "freshness_status": freshness_status,
    "relative_share": relative_share,
    "top_events_last_7": top_events_last_7,
    "insight_conversion_any": insight_conversion_any,
    "insight_retention_any": insight_retention_any,
    "insight_volume_any": insight_volume_any,
    "insights_weekly": insights_weekly,
    "insights_own_rules": insights_own_rules,
    "user_journey": user_journey,
    "journey_sample": journey_sample,
    "user_totals": user_totals,
    "user_top_events": user_top_events,
    "user_metrics": user_metrics,
    "user_patterns": user_patterns,
    "user_narrative": user_narrative,
    "user_focus": user_focus,
    "intent_tags": intent_tags,
    "phrase_tags": phrase_tags,
    "user_narrative_trailing": user_narrative_trailing,
    "affected_users": affected_users,
    "dashboard_overview": dashboard_overview,
    "daily_activity_stream": daily_activity_stream,
    "daily_activity_watermark": daily_activity_stream,
    "investigate_insights": investigate_insights,
    "event_sample": event_sample,
}


def oracle_sql() -> dict[str, str]:
    return {k: f() for k, f in ORACLES.items()}
