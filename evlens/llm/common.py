"""Helpers shared by the training-data operators: table access, shared folder, Arrow maps."""
from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Words of every operator that splits on ASCII white space: [^\x20\x09-\x0D]+.
# bytes.split() without arguments cuts at exactly these six bytes.
SPACES = " \t\n\x0b\x0c\r"
WORD_BREAK = r"[\x20\x09-\x0D]+"

_REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    workers_find_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def workers_find_package(spark: SparkSession) -> None:
    """Let Python workers import this package when it is not installed on them."""
    env = spark.sparkContext.environment
    known = env.get("PYTHONPATH", "")
    if _REPO not in known.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(p for p in (_REPO, known) if p)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    On a cluster a missing setting is an error; a local session gets a scratch folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="llm-shared-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives lost executors.

    The shuffle files of the job that wrote it are no longer needed then, so Spark is
    asked to drop them when it ends; the session's own setting comes back afterwards.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/llm-{name}-{uuid.uuid4().hex[:12]}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)
    back = spark.read.schema(df.schema).parquet(path)
    back.stored_path = path
    return back


def discard(table: DataFrame) -> None:
    """Delete a table that ``stored`` wrote, once what was made of it is stored itself."""
    spark = table.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(table.stored_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


BATCH_BYTES = 1 << 20       # text a worker looks at together; one longer text is a batch by itself


def sliced(batches: Iterator[pa.RecordBatch], limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds at most ``limit`` bytes of its ``text`` column, or one row."""
    for b in batches:
        at = b.schema.get_field_index("text")
        if at < 0 or not b.num_rows:
            yield b
            continue
        size = pc.fill_null(pc.binary_length(b.column(at)), 0).to_numpy(zero_copy_only=False).cumsum()
        i = 0
        while i < b.num_rows:
            before = size[i - 1] if i else 0
            j = max(i + 1, int(np.searchsorted(size, before + limit, "right")))
            yield b.slice(i, j - i)
            i = j


def arrow_map(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``mapInArrow`` over ``df`` in batches of bounded text, with worker imports settled."""
    workers_find_package(df.sparkSession)
    return df.mapInArrow(lambda batches: fn(sliced(batches)), schema)


def texts_of(batch: pa.RecordBatch, column: str) -> list[str]:
    """A text column as Python strings; null reads as empty."""
    return [t or "" for t in batch.column(batch.schema.get_field_index(column)).to_pylist()]


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns the operators read, under fixed names, whatever else the table holds."""
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"),
                       F.col(f"`{text_col}`").cast("string").alias("text"))
