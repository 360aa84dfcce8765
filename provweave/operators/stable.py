"""Results that are computed once and survive lost executors."""

from __future__ import annotations

import atexit
import contextlib
import threading
import uuid
from collections.abc import Callable, Iterator

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_WRITTEN: list[tuple[SparkSession, str]] = []
_HERE = threading.local()
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BATCH, ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000


@contextlib.contextmanager
def _set(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def sweeping(spark: SparkSession) -> contextlib.AbstractContextManager[None]:
    """Shuffle files of a query that is written inside go with its end, not when the driver happens to collect its garbage."""
    return _set(spark, _CLEANUP, "true")


def in_small_batches(spark: SparkSession) -> contextlib.AbstractContextManager[None]:
    """Rows go to Python workers ROWS at once: large batches, of which a socket takes little at a time, seemed to cost the JVM far more time."""
    return _set(spark, _BATCH, str(ROWS))


def stores(spark: SparkSession) -> bool:
    """Whether ``stable`` writes files."""
    return bool(spark.sparkContext.getConf().get("spark.checkpoint.dir"))


def stable(df: DataFrame) -> DataFrame:
    """Store below ``spark.checkpoint.dir`` where the session has it; else keep two copies (one machine: one).

    Stored as Parquet and not as a checkpoint, which takes rows as they lie in memory: several times the
    disk, and every column of every row for each reader.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    shared = context.getConf().get("spark.checkpoint.dir")
    if shared:
        path = f"{shared.rstrip('/')}/provweave-{uuid.uuid4().hex}"
        held = getattr(_HERE, "held", None)
        (_WRITTEN if held is None else held).append((spark, path))
        with sweeping(spark), in_small_batches(spark):
            df.write.option("compression", "zstd").parquet(path)
        return spark.read.schema(df.schema).parquet(path)
    if context.getCheckpointDir():
        return df.checkpoint()
    local = context.master.startswith("local[") or context.master == "local"
    return df.persist(StorageLevel.MEMORY_AND_DISK if local else StorageLevel.MEMORY_AND_DISK_2)


@contextlib.contextmanager
def passing() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """What this thread stores inside goes at the end: for work that returns nothing lazy, or what ``stable`` as it is yielded has stored."""
    outer, _HERE.held = getattr(_HERE, "held", None), []

    def lasting(df: DataFrame) -> DataFrame:
        inner, _HERE.held = _HERE.held, outer
        try:
            return stable(df)
        finally:
            _HERE.held = inner

    try:
        yield lasting
    finally:
        held, _HERE.held = _HERE.held, outer
        _drop(held)


def _drop(written: list[tuple[SparkSession, str]]) -> None:
    while written:
        spark, path = written.pop()
        with contextlib.suppress(Exception):  # the JVM may be gone already
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


atexit.register(_drop, _WRITTEN)


def dense_ids(rows: DataFrame, order: list, name: str, first: int = 0) -> DataFrame:
    """``rows`` with ids ``first``, ``first`` + 1, ... in the given order.

    Ranges are sorted in their own tasks; only the number of rows of each range is summed in one.
    """
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(tasks, *order).sortWithinPartitions(*order)
    at = stable(ranged.withColumn("_at", F.monotonically_increasing_id()).withColumn("_range", F.shiftright("_at", 33)))
    sizes = at.groupBy("_range").agg(F.count("*").alias("_n"), F.min("_at").alias("_low"))
    before = sizes.select("_range", "_low", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))
    return at.join(F.broadcast(before), "_range").withColumn(name, F.col("_at") - F.col("_low") + F.col("_before") + F.lit(first)).drop("_at", "_range", "_low", "_before")
