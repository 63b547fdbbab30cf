"""Small literal tables built inside the JVM plan (no Python-side rows to ship)."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def literal_frame(spark: SparkSession, columns: list[tuple[str, str]], rows: list[tuple]) -> DataFrame:
    """A DataFrame of ``rows`` with ``columns`` = [(name, sql type)], planned as a local
    table scan (``inline`` over an array of literal structs)."""
    structs = [F.struct(*[F.lit(v).cast(t).alias(n) for (n, t), v in zip(columns, row)]) for row in rows]
    if not structs:
        empty = ", ".join(f"{n} {t}" for n, t in columns)
        return spark.range(0).select(F.inline(F.array().cast(f"array<struct<{empty}>>")))
    return spark.range(1).select(F.inline(F.array(*structs)))
