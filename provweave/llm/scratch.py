"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}
_WRITTEN: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder only where driver and executors are one process."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local[") and master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="provweave-")
    return _LOCAL[app]


def table(df: DataFrame, name: str, tasks: int | None = None) -> DataFrame:
    """Write ``df`` once below the shared folder and return a scan of what was written.

    The files outlive lost executors, cut the lineage and give the planner true
    sizes, so that a later join broadcasts only what fits its threshold.  ``tasks``: at most so
    many tasks, and files, for tables of a few columns that JVM operators make.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/provweave-{uuid.uuid4().hex}/{name}"
    (df if tasks is None else df.coalesce(tasks)).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path)
    _WRITTEN.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def free(*tables: DataFrame) -> None:
    """Delete tables that nothing lazy reads any more; others go at the end of the session."""
    for entry in [(t.sparkSession, t.stored_at) for t in tables]:
        _drop(*entry)
        _WRITTEN.remove(entry)


def few(spark: SparkSession) -> int:
    """Tasks for a small table: two for each core."""
    return 2 * spark.sparkContext.defaultParallelism


def _drop(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path).getParent()
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def release(spark: SparkSession) -> None:
    """Delete the tables written by this session; results read from them must be stored first."""
    for entry in [x for x in _WRITTEN if x[0] is spark]:
        _drop(*entry)
        _WRITTEN.remove(entry)


def _at_exit() -> None:
    for spark in {id(s): s for s, _ in _WRITTEN}.values():
        with contextlib.suppress(Exception):  # the JVM may be gone already
            if spark.sparkContext._jsc is not None:
                release(spark)
    for folder in _LOCAL.values():
        shutil.rmtree(folder, ignore_errors=True)


atexit.register(_at_exit)
