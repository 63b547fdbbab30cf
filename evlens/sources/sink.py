"""Result sink (A8): results are lazy DataFrames; this writes them out."""
from __future__ import annotations

from pyspark.sql import DataFrame

from evlens.schema import DATE, NAME, TS, USER


def write_events(events: DataFrame, path: str, mode: str = "overwrite", row_group_bytes: int | None = None) -> None:
    """Write canonical events as Parquet partitioned by ``event_date``.

    Range-partitioned and sorted by (day, event name, time): each task writes one contiguous
    slice, so a task touches few day folders, and a very busy day, or event of a day,
    is spread over many tasks instead of landing in one. A query for some events (a funnel)
    skips the row groups and pages of the others by their bounds. Row groups carry a Bloom filter
    of their users, sized by the users found, unless a dictionary already lists them; a query for
    one user (a journey) skips the row groups without that user.
    ``row_group_bytes`` overrides Parquet's size of a row group.
    """
    writer = (events.repartitionByRange(DATE, NAME, TS).sortWithinPartitions(DATE, NAME, TS)
              .write.mode(mode)
              .option(f"parquet.bloom.filter.enabled#{USER}", "true")
              .option("parquet.bloom.filter.adaptive.enabled", "true"))
    if row_group_bytes is not None:
        writer = writer.option("parquet.block.size", str(row_group_bytes))
    writer.partitionBy(DATE).parquet(path)


def write_result(df: DataFrame, path: str, mode: str = "overwrite", fmt: str = "parquet") -> None:
    df.write.mode(mode).format(fmt).save(path)
