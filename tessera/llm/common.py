"""What the operators share: the shared work folder, tables in it, and parallelism."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from the session's spark.checkpoint.dir.

    Only where that setting is missing in a local session, as in tests, a folder of our own is set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not (spark.sparkContext.master + "[").startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tessera-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


#: Spark removes a finished execution's shuffle files where this is set; they would stay until the driver collects garbage.
_FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bytes of a batch on its way to a Python worker: for every task the JVM holds buffers of some batches outside its heap, and so does the worker.
_BATCH_BYTES = {"spark.sql.execution.arrow.maxBytesPerBatch": "4m"}


@contextlib.contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """The session with ``values`` set, and afterwards as it was."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def small_batches(spark: SparkSession) -> contextlib.AbstractContextManager[None]:
    """While it holds, batches to Python workers have few bytes, however long the rows."""
    return settings(spark, _BATCH_BYTES)


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a table written to the shared folder: cuts lineage and survives lost executors.

    Once it stands nothing reads the shuffles that made it, so their files go at once.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    with settings(spark, {_FREE_SHUFFLES: "true"}), small_batches(spark):
        df.write.parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found.work_path = path
    return found


def discard(*tables: DataFrame) -> None:
    """Delete written tables that nothing reads any more."""
    for table in tables:
        path = getattr(table, "work_path", None)
        if path:
            target = table.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(table.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def text_or_empty(df: DataFrame, text: str = "text") -> Column:
    return F.coalesce(F.col(text), F.lit("")).alias(text)


def free_prefix(df: DataFrame) -> str:
    """A prefix of work columns' names that no column of ``df`` begins with, in either case."""
    found = "w_"
    while any(c.lower().startswith(found) for c in df.columns):
        found = "w" + found
    return found


def slices(frames: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Smaller batches: a worker then holds the Python objects of so many rows only."""
    for frame in frames:
        for at in range(0, frame.num_rows, rows):
            yield frame.slice(at, rows)
