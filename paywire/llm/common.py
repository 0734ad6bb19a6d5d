"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = ASCII_UPPER.lower()
LOWER_TABLE = bytes.maketrans(ASCII_UPPER.encode(), ASCII_LOWER.encode())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir.  Only a local session may go without; it gets one of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "/tmp/checkpoints/paywire"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class _Scopes(threading.local):
    def __init__(self) -> None:
        self.open: list[Scratch] = []


_SCOPES = _Scopes()


class Scratch:
    """Tables that `saved` and `bucketed` wrote since the scope was opened."""

    def __init__(self) -> None:
        self.paths: list[str] = []

    def keep_last(self) -> None:
        """The table written last outlives this scope; a scope around it may still remove it."""
        path = self.paths.pop()
        if len(_SCOPES.open) > 1:
            _SCOPES.open[-2].paths.append(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Scratch]:
    """Removes the tables written inside, except those kept.  For code whose result is written before it ends.

    It is also the handle for what a query leaves behind: `with scratch(spark): query(spark, sf_dir).write.parquet(...)`
    removes all that the query wrote for itself.
    """
    scope = Scratch()
    _SCOPES.open.append(scope)
    try:
        yield scope
    finally:
        _SCOPES.open.pop()
        for path in scope.paths:
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(place, True)


def new_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark)}/paywire-{label}-{uuid.uuid4().hex}"
    if _SCOPES.open:
        _SCOPES.open[-1].paths.append(path)
    return path


def saved(df: DataFrame, label: str) -> DataFrame:
    """Write to a new Parquet table in the shared folder and read it back.

    It cuts the lineage: a lost executor costs only the tasks it was running.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def input_bytes(df: DataFrame) -> int | None:
    """Bytes of the tables below df, as Spark knows them without running anything; None where it doesn't."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size()))
    return size if size < 1 << 60 else None


def bucket_count(df: DataFrame) -> int:
    """One bucket for as many bytes as a scan's task reads, or for 2 MB where that would leave cores idle, and never more than Spark allows."""
    spark = df.sparkSession
    most = int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets"))
    size = input_bytes(df)
    if size is None:
        return max(1, min(most, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    a_task = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    return max(1, min(most, max(-(-size // a_task), min(spark.sparkContext.defaultParallelism, -(-size // (2 << 20))))))


def bucketed(df: DataFrame, label: str, key: str, n: int) -> DataFrame:
    """As `saved`, in n buckets of `key`: a join on it then moves the other side only.

    Rows do not shuffle on the way.  A task writes a file for each bucket that its own keys fall in; each row,
    which is a block of rows, is a row group of its own, so a reader holds one at a time.
    """
    spark = df.sparkSession
    path, name = new_path(spark, label), f"paywire_{uuid.uuid4().hex}"
    df.write.format("parquet").option("path", path).option("parquet.block.row.count.limit", 1).bucketBy(n, key).saveAsTable(name)
    found = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the name only: files at a path of their own stay
    return found


@contextmanager
def arrow_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of at most so many rows while what is inside runs: whole texts go to Python a few MB at a time."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(key)
    spark.conf.set(key, min(rows, int(old)) if int(old) > 0 else rows)
    try:
        yield
    finally:
        spark.conf.set(key, old)


#: What a worker process keeps between the tasks of one operator: its name, and how to let go of it.
MEMOS: dict[str, Callable[[], None]] = {}


def free_memory(keep: str | None = None) -> None:
    """Let go of what other operators' tasks left in this worker, and give freed memory back to the system."""
    for name, clear in MEMOS.items():
        if name != keep:
            clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def id_bucket(column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo; NULL ids go to bucket 0."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % modulus, F.lit(0))


def lower_ascii(c: Column) -> Column:
    return F.translate(c, ASCII_UPPER, ASCII_LOWER)
