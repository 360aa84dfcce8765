"""Derived corpora and their interchange forms, made once per session in the shared folder."""

from __future__ import annotations

import atexit
import contextlib
import math
import shutil
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.stable import sweeping
from ..sources import files
from . import codec, corpora, workspace

#: Bytes of tables that are made into documents at once, so that shuffle files are of these alone; shares at most.
SHARE, MOST = 32 << 20, 16

_MADE: dict[tuple, str] = {}
_TOPS: dict[str, str] = {}


def _top(spark: SparkSession) -> str:
    app = spark.sparkContext.applicationId
    if app not in _TOPS:
        _TOPS[app] = f"{workspace.shared(spark)}/provweave-{uuid.uuid4().hex}"
    return _TOPS[app]


def corpus(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """(graph, body) of the corpus ``name`` (commerce, dialogue, telemetry), as Parquet."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _MADE:
        path = f"{_top(spark)}/{name}-{len(_MADE)}"
        n = max(1, min(MOST, math.ceil(corpora.input_bytes(spark, sf_dir, name) / SHARE)))
        with sweeping(spark):
            for i in range(n):
                docs = getattr(corpora, name)(spark, sf_dir, (i, n))
                docs.write.mode("append" if i else "overwrite").option("compression", "zstd").parquet(path)
        _MADE[key] = path
    return spark.read.schema("graph string, body string").parquet(_MADE[key])


def folder(spark: SparkSession, sf_dir: str, name: str, make) -> str:
    """A folder that ``make(path)`` has filled."""
    key = (spark.sparkContext.applicationId, sf_dir, f"{name}/")
    if key not in _MADE:
        path = f"{_top(spark)}/{name}-{len(_MADE)}"
        make(path)
        _MADE[key] = path
    return _MADE[key]


def tree(spark: SparkSession, sf_dir: str, name: str = "dialogue") -> str:
    """A corpus as a directory of documents, one file each."""
    return folder(spark, sf_dir, f"tree-{name}", lambda path: codec._write_each(corpus(spark, sf_dir, name), path, "body", indent=False))


def artifact(spark: SparkSession, sf_dir: str, name: str = "dialogue") -> str:
    """The interchange form of ``tree``, with statistics and a verification log."""
    source = tree(spark, sf_dir, name)
    return folder(spark, sf_dir, f"artifact-{name}", lambda path: codec.compress_directory(spark, source, path, verify=True))


def rebuilt(spark: SparkSession, sf_dir: str, name: str = "dialogue") -> str:
    """The documents that ``artifact`` gives back."""
    source = artifact(spark, sf_dir, name)
    return folder(spark, sf_dir, f"rebuilt-{name}", lambda path: codec.decompress_directory(spark, source, path))


def pages_tree(spark: SparkSession, sf_dir: str) -> str:
    """A directory with documents, sidecars and hidden files, one of six names for each page."""
    names = ("task.json", "_x.json", "manifest.json", "my_corpus_manifest.json", ".hidden.json", "run.transcript.json")
    name = F.element_at(F.array(*map(F.lit, names)), (F.col("page_id") % 6 + 1).cast("int"))
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    docs = pages.select(F.concat(F.lit("p"), F.col("page_id").cast("string"), F.lit("/"), name).alias("graph"), F.concat(F.lit('{"url":"'), "url", F.lit('"}')).alias("body"))
    return folder(spark, sf_dir, "pages", lambda path: codec._write_each(docs, path, "body", indent=False))


def _at_exit() -> None:
    for top in _TOPS.values():
        if files.is_local(top):
            shutil.rmtree(files.plain(top), ignore_errors=True)
        else:
            with contextlib.suppress(Exception):  # the JVM may be gone already
                files.delete(SparkSession.active(), top)


atexit.register(_at_exit)
