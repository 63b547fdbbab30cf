"""Tiny canonical event tables for unit tests."""
from __future__ import annotations

from datetime import datetime, timezone

from evlens.schema import EVENT_SCHEMA

D = 86_400_000_000
H = 3_600_000_000
M = 60_000_000


def us(ts: str) -> int:
    """'2024-01-01 00:00:00[.ffffff]' read as UTC -> micros."""
    fmt = "%Y-%m-%d %H:%M:%S.%f" if "." in ts else "%Y-%m-%d %H:%M:%S"
    dt = datetime.strptime(ts, fmt).replace(tzinfo=timezone.utc)
    return int(dt.timestamp()) * 1_000_000 + dt.microsecond


def shard(micros: int) -> str:
    return datetime.fromtimestamp(micros / 1e6, tz=timezone.utc).strftime("%Y%m%d")


def ev(user, name, t, *, date=None, platform="WEB", country="US", region="AMERICA", city=None,
       category="mobile", os=None, version="1.0", params=None, props=None):
    """One canonical row; ``t`` is micros or a UTC timestamp string."""
    micros = us(t) if isinstance(t, str) else t

    def kv(d):
        out = []
        for k, v in (d or {}).items():
            if isinstance(v, bool) or v is None:
                val = (None, None, None, None)
            elif isinstance(v, int):
                val = (None, v, None, None)
            elif isinstance(v, float):
                val = (None, None, None, v)
            else:
                val = (v, None, None, None)
            out.append((k, val))
        return out

    return (date or shard(micros), micros, name, user, platform, (country, region, city),
            (category, os), (None, version), (None, None, None), kv(params), kv(props))


def frame(spark, rows):
    return spark.createDataFrame(rows, EVENT_SCHEMA)
