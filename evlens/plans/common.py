"""Shared helpers for registered queries."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evlens.sources.canonical import canonical_events


def events(spark: SparkSession, sf_dir: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Canonical events of the given tables, lazily: nothing is written or counted.

    ``start`` / ``end`` are the first and last day a query reads of them (earlier
    periods included); they become a pushed filter of the Parquet scan.
    """
    return canonical_events(spark, sf_dir, start, end)


def finish(df: DataFrame, digits: int = 6) -> DataFrame:
    """Comparison form: doubles rounded to ``digits``, dates as ISO strings."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c, digits)
        elif isinstance(f.dataType, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        cols.append(c.alias(f.name))
    return df.select(*cols)
