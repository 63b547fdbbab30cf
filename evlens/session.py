"""Session helpers: sensible defaults for local runs, and the shared folder."""
from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

# Settings every evlens job relies on. AQE re-plans joins from real shuffle sizes
# (broadcast only when the measured side is under the threshold), splits skewed
# partitions and coalesces tiny ones.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.ansi.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # Partition values such as event_date=20240105 must stay strings.
    "spark.sql.sources.partitionColumnTypeInference.enabled": "false",
    # Counts and bounds per day from Parquet footers (sources.footers).
    "spark.sql.parquet.aggregatePushdown": "true",
}


def scale_conf(input_bytes: int, executors_cores: int, scan_split_bytes: int = 256 << 20,
               shuffle_partition_bytes: int = 200 << 20, shuffle_ratio: float = 0.25) -> dict[str, str]:
    """Settings sized for a given input volume.

    ``shuffle_ratio`` is the expected size of the largest shuffle relative to the
    input: every operator here aggregates map-side before its first shuffle, so
    shuffles are a fraction of the scanned bytes. The initial partition count keeps
    each reducer near ``shuffle_partition_bytes`` (well inside executor memory, so
    sorts and aggregates rarely spill) and AQE coalesces whatever turns out smaller;
    it never drops below two waves of the cluster's cores.
    """
    shuffle_parts = max(2 * executors_cores, int(input_bytes * shuffle_ratio // shuffle_partition_bytes) + 1)
    return {
        "spark.sql.files.maxPartitionBytes": str(scan_split_bytes),
        "spark.sql.shuffle.partitions": str(shuffle_parts),
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(shuffle_parts),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(shuffle_partition_bytes),
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(4 * shuffle_partition_bytes),
    }


def build_session(master: str | None = None, app: str = "evlens",
                  shuffle_partitions: int | None = None,
                  extra: dict[str, str] | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, named by ``spark.checkpoint.dir``.

    On a cluster an unset folder is an error: a folder of one machine cannot be
    shared. A local session without the setting gets a scratch folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="evlens-shared-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")
