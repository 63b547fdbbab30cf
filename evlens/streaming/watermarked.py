"""Daily active users with an event-time watermark (X1): duplicates are dropped from a state store.

``daily_active`` keeps every day-user pair in a table and lets nothing expire. Here the
state store keeps the pairs, and only for as long as the watermark allows: the first row
of a day and user passes and later ones are dropped until ``delay`` after it. With a
delay of at least one day nothing counts twice, as whatever comes later than that and
still passes the watermark is of another day. Memory is bounded by the users active
within the delay.

What passes is added up per micro-batch and day, so the kept table has one row for each,
and a batch that is run again overwrites its own rows. Rows older than the watermark are
not counted; how many each micro-batch lost is a side table.
"""
from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from evlens.schema import DATE, TS, USER
from evlens.session import shared_folder

DELAY = "2 days"
_COUNTS = f"{DATE} string, users long, batch long"
_LATE = "input_rows long, late_rows long, watermark string, batch long"
_DAYS = re.compile(r"^[1-9]\d* days?$")
_PROGRESS = "spark.sql.streaming.numRecentProgressUpdates"


def day_user_pairs(stream: DataFrame, delay: str = DELAY) -> DataFrame:
    """The first row of every (shard day, user) of a canonical event stream, by event time."""
    if not _DAYS.match(delay):
        raise ValueError(f"the delay must be a number of whole days, from 1 day on, got {delay!r}")
    return (stream.select(DATE, USER, F.timestamp_micros(TS).alias("event_time"))
            .withWatermark("event_time", delay).dropDuplicatesWithinWatermark([DATE, USER]))


def drain(stream: DataFrame, name: str, delay: str = DELAY) -> str:
    """Read all that is there (``availableNow``); returns the folder of the kept tables.

    Called again with the same name, by the same process or another, it goes on where it
    ended, with the state it had. The side table of a batch is written when the next one
    starts or the drain ends, from what Spark reports of it; if the process is lost in
    between, that batch's late rows stay uncounted there, and nowhere else.
    """
    spark = stream.sparkSession
    path = f"{shared_folder(spark)}/{name}"
    running: list[StreamingQuery] = []
    told: set[int] = set()

    def tell() -> None:
        for p in running[0].recentProgress if running else []:
            if p["batchId"] not in told:
                told.add(p["batchId"])
                late = sum(s["numRowsDroppedByWatermark"] for s in p["stateOperators"])
                row = (p["numInputRows"], late, p["eventTime"].get("watermark"))
                (spark.createDataFrame([row], "input_rows long, late_rows long, watermark string")
                 .coalesce(1).write.mode("overwrite").parquet(f"{path}/late/batch={p['batchId']}"))

    def add(batch: DataFrame, epoch: int) -> None:
        batch.groupBy(DATE).agg(F.count(USER).alias("users")).write.mode("overwrite").parquet(f"{path}/counts/batch={epoch}")
        tell()

    before = spark.conf.get(_PROGRESS, None)
    spark.conf.set(_PROGRESS, "1000")
    try:
        query = (day_user_pairs(stream, delay).writeStream.outputMode("append").foreachBatch(add)
                 .option("checkpointLocation", f"{path}/progress").trigger(availableNow=True).start())
        running.append(query)
        query.awaitTermination()
        tell()
    finally:
        spark.conf.unset(_PROGRESS) if before is None else spark.conf.set(_PROGRESS, before)
    return path


def daily_active(spark: SparkSession, path: str) -> DataFrame:
    """(day, dau) of what ``drain`` counted. Days whose users are all NULL count 0, as in the batch form."""
    table = spark.read.schema(_COUNTS).parquet(f"{path}/counts")
    return table.groupBy(F.to_date(F.col(DATE), "yyyyMMdd").alias("day")).agg(F.sum("users").alias("dau"))


def late_rows(spark: SparkSession, path: str) -> DataFrame:
    """(batch, input_rows, late_rows, watermark): what each micro-batch read and dropped as too late."""
    return spark.read.schema(_LATE).parquet(f"{path}/late")


def run_available_now(stream: DataFrame, name: str | None = None, delay: str = DELAY) -> DataFrame:
    """Drain ``stream`` into a new folder (or the named one) and count it."""
    return daily_active(stream.sparkSession, drain(stream, name or f"evlens-watermarked-{uuid.uuid4().hex[:12]}", delay))
