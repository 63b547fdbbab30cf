"""Time helpers on microsecond columns; none depends on the session time zone."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from evlens.schema import MICROS_PER_DAY, MICROS_PER_HOUR, TS


def ntz_to_micros(ts: Column) -> Column:
    """Microseconds since the epoch of a TIMESTAMP_NTZ read as UTC wall time."""
    return (F.unix_date(F.to_date(ts)).cast("long") * MICROS_PER_DAY
            + F.hour(ts).cast("long") * MICROS_PER_HOUR
            + F.minute(ts).cast("long") * 60_000_000
            + (F.extract(F.lit("SECOND"), ts) * 1_000_000).cast("long"))


def idiv(a: Column, b) -> Column:
    """Integer division truncating toward zero (SQL ``div``)."""
    return F.call_function("div", a, b if isinstance(b, Column) else F.lit(b))


def whole_days(later: Column, earlier: Column) -> Column:
    """Whole 24 h units between two micros values, truncated toward zero."""
    return idiv(later - earlier, MICROS_PER_DAY)


def whole_hours(later: Column, earlier: Column) -> Column:
    return idiv(later - earlier, MICROS_PER_HOUR)


def utc_day(micros: Column | None = None) -> Column:
    """UTC calendar day number (days since 1970-01-01) of a micros column."""
    m = F.col(TS) if micros is None else micros
    return F.floor(m / F.lit(MICROS_PER_DAY)).cast("int")


def day_to_date(day: Column) -> Column:
    return F.date_from_unix_date(day)


def shard_to_date(shard: Column) -> Column:
    """PARSE_DATE('%Y%m%d', event_date)."""
    return F.to_date(shard, "yyyyMMdd")
