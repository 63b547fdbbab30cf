"""Date-sharded scans (A1-A6). All bounds are inclusive yyyyMMdd strings."""
from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evlens.functions.periods import check_day, extended_start, parse_day, relative_window
from evlens.schema import DATE, NAME, TS, USER


def scan(events: DataFrame, start: str, end: str) -> DataFrame:
    """Events whose shard day lies in [start, end] (A1).

    Non-digit shards (e.g. intraday tables) sort after every digit string and so
    fall outside any range of 8-digit days.
    """
    return events.where(F.col(DATE).between(check_day(start), check_day(end)))


def scan_day(events: DataFrame, day: str) -> DataFrame:
    """One shard (A2)."""
    return events.where(F.col(DATE) == check_day(day))


def sample_day(events: DataFrame, day: str, limit: int | None = None) -> DataFrame:
    """One shard, optionally a sample of ``limit`` of its rows (A3).

    The sample is the bottom ``limit`` of a digest of time, user and event: each task keeps
    its own bottom rows and these are merged, so it is the same under any partitioning,
    order or retry. Rows alike in all three are told apart by their params and properties;
    those still alike are interchangeable.
    """
    df = scan_day(events, day)
    if limit is None:
        return df
    rank = F.md5(F.concat_ws(" ", F.col(TS).cast("string"), F.coalesce(USER, F.lit("")), F.coalesce(NAME, F.lit(""))))
    tie = F.xxhash64("platform", F.to_json("event_params"), F.to_json("user_properties"))
    return df.select("*", rank.alias("_rank"), tie.alias("_tie")).orderBy("_rank", "_tie").limit(limit).drop("_rank", "_tie")


def tag_periods(events: DataFrame, periods: dict[str, tuple[str, str]], col: str = "period") -> DataFrame:
    """One scan of the union of several ranges with a period label column (A4).

    Disjoint ranges get a ``CASE`` label; overlapping ranges duplicate the rows that
    fall in several periods so each period sees its full range.
    """
    items = [(name, check_day(s), check_day(e)) for name, (s, e) in periods.items()]
    overall = events.where(F.col(DATE).between(min(s for _, s, _ in items), max(e for _, _, e in items)))
    ordered = sorted(items, key=lambda t: t[1])
    disjoint = all(ordered[i][2] < ordered[i + 1][1] for i in range(len(ordered) - 1))
    conds = [(name, F.col(DATE).between(s, e)) for name, s, e in items]
    if disjoint:
        label = None
        for name, c in conds:
            label = F.when(c, F.lit(name)) if label is None else label.when(c, F.lit(name))
        return overall.withColumn(col, label).where(F.col(col).isNotNull())
    labels = F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in conds]))
    return overall.withColumn(col, F.explode(labels))


def extended_scan(events: DataFrame, start: str, end: str) -> DataFrame:
    """Analysis window plus an equally long window before it (A5)."""
    return scan(events, extended_start(start, end), end)


def recent_scan(events: DataFrame, as_of: date | str, days_back: int = 3) -> DataFrame:
    """The last ``days_back`` days up to and including ``as_of``."""
    d = parse_day(as_of) if isinstance(as_of, str) else as_of
    s, e = relative_window(days_back, d)
    return scan(events, s, e)
