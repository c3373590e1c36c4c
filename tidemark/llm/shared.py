"""Materialising intermediate tables in the cluster's shared folder, and size-checked joins."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only when it was counted and has no more rows and no more stored bytes than this.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 8 << 20
#: Spark's own setting for deleting a query's shuffle files when the query has ended.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Spark's own setting for the bytes of a batch of rows that goes to Python, and its value in :func:`small_batches`.
ARROW_BYTES, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``. Only where that is unset and everything runs in one process (tests) is it a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    own = spark.conf.get("tidemark.shared.dir", None)
    if not own:
        own = tempfile.mkdtemp(prefix="spark-tidemark-")
        spark.conf.set("tidemark.shared.dir", own)
    return own.rstrip("/")


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Queries that run in here hand rows to Python in batches of ``BATCH_BYTES``; by Spark's number of rows alone, 10,000 texts are one batch, which an
    executor holds in each of its tasks, outside of its heap, and in each task's Python worker."""
    before = spark.conf.get(ARROW_BYTES)
    spark.conf.set(ARROW_BYTES, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.set(ARROW_BYTES, before)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: lineage ends there, and lost executors cost nothing. The shuffle files of the
    write are deleted when it ends, since nothing reads them again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def _folder(df: DataFrame):
    """The folder of a table made by :func:`stored`, with its file system; None if it has no file."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(file).getParent()
        return folder, folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return None


def stored_bytes(df: DataFrame) -> int:
    """Bytes of a table made by :func:`stored`, compressed as they lie there."""
    found = _folder(df)
    return found[1].getContentSummary(found[0]).getLength() if found else 0


def discard(*tables: DataFrame) -> None:
    """Deletes tables made by :func:`stored` that no later plan reads."""
    for df in tables:
        if found := _folder(df):
            found[1].delete(found[0], True)


def named(column: str) -> Column:
    """The top-level column of exactly this name, dots and back quotes included."""
    return F.col("`" + column.replace("`", "``") + "`")


def whole_row(df: DataFrame) -> Column:
    """All columns of ``df`` as one, whatever their names."""
    return F.struct(*map(named, df.columns))


def join_small(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Joins; ``right`` (a stored table) is broadcast if its counted rows and bytes allow, else both sides are shuffled."""
    small = right.count() <= BROADCAST_ROWS and stored_bytes(right) <= BROADCAST_BYTES
    return left.join(F.broadcast(right) if small else right, on, how)
