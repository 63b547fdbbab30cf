"""Streaming daily active users (X1): the streaming form of ``events.daily_activity``.

Each micro-batch adds its distinct (shard day, user) pairs to a table in the shared
folder, and the counts are taken from that table. Nothing expires, so files may come in
any order and a late row still counts; nothing is held in state, so memory does not grow.
A batch that is run again overwrites its own part of the table.
"""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evlens.schema import DATE, USER
from evlens.session import shared_folder
from evlens.sources.canonical import core_columns


def flat_event_stream(spark: SparkSession, sf_dir: str, max_files_per_trigger: int = 1000) -> DataFrame:
    """Stream the flat ``events`` files of the test warehouse in canonical core form.

    ``max_files_per_trigger`` bounds each micro-batch, so draining a large backlog
    with ``availableNow`` runs as a sequence of bounded batches.
    """
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    # A file stream reads a folder; the filter keeps it to the events file(s).
    raw = (spark.readStream.schema(schema).option("pathGlobFilter", "events*.parquet")
           .option("recursiveFileLookup", "true").option("maxFilesPerTrigger", max_files_per_trigger)
           .parquet(sf_dir))
    return raw.select(*core_columns())


def drain(stream: DataFrame, name: str) -> str:
    """Read all that is there (``availableNow``) into a table of day-user pairs; returns its path.

    Called again with the same name by the same process or another, it goes on where it ended.
    """
    path = f"{shared_folder(stream.sparkSession)}/{name}"

    def add(batch: DataFrame, epoch: int) -> None:
        batch.select(DATE, USER).distinct().write.mode("overwrite").parquet(f"{path}/pairs/batch={epoch}")

    query = (stream.writeStream.foreachBatch(add).option("checkpointLocation", f"{path}/progress")
             .trigger(availableNow=True).start())
    query.awaitTermination()
    return f"{path}/pairs"


def daily_active(spark: SparkSession, pairs: str) -> DataFrame:
    """(day, dau) from the table ``drain`` keeps. Days whose users are all NULL count 0, as in the batch form."""
    table = spark.read.schema(f"{DATE} string, {USER} string, batch long").parquet(pairs)
    return table.groupBy(F.to_date(F.col(DATE), "yyyyMMdd").alias("day")).agg(F.count_distinct(USER).alias("dau"))


def run_available_now(stream: DataFrame, name: str | None = None) -> DataFrame:
    """Drain ``stream`` into a new table (or the named one) and count it."""
    return daily_active(stream.sparkSession, drain(stream, name or f"evlens-stream-{uuid.uuid4().hex[:12]}"))
