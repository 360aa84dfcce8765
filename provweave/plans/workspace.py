"""Folders for intermediate results that all executors must see."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import SparkSession

from ..sources import files


def shared(spark: SparkSession, given: str | None = None) -> str:
    """``given``, else ``spark.checkpoint.dir``; a temporary folder only where driver and executors are one process."""
    context = spark.sparkContext
    found = given or context.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not context.master.startswith("local[") and context.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.gettempdir()


@contextlib.contextmanager
def folder(spark: SparkSession, given: str | None = None) -> Iterator[str]:
    """A new folder below the shared one, deleted at the end."""
    path = f"{shared(spark, given)}/provweave-{uuid.uuid4().hex}"
    try:
        yield path
    finally:
        files.delete(spark, path)
