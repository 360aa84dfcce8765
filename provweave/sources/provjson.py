"""The ``provjson`` data source: directories of PROV-JSON documents.

Spark's own file sources drop names that begin with ``_``, which are documents here, so the
driver lists files (mounted roots directly, others through Hadoop's file systems) and executors read runs
of them, each through the path or URI of the root (see ``files``).  ``read_corpus`` deals out the runs itself: for each
read of a Python data source the driver starts Python processes that stay, some 33 MB each.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..config import SIDECAR_NAMES, SIDECAR_SUFFIX
from . import files

SCHEMA = "graph string, body string, n_bytes long, read_error string"


def is_document_name(path: str) -> bool:
    """Whether a file of a corpus tree is a document by its name, not a sidecar."""
    name = path.rsplit("/", 1)[-1]
    return name.endswith(".json") and name not in SIDECAR_NAMES and not name.endswith(SIDECAR_SUFFIX)


def document_name(path: Column) -> Column:
    """``not a sidecar``, as a column: exact names and one suffix."""
    name = F.element_at(F.split(path, "/"), -1)
    return ~name.isin(*sorted(SIDECAR_NAMES)) & ~name.endswith(SIDECAR_SUFFIX)


def document_files(spark: SparkSession, root: str) -> list[tuple[str, int]]:
    """(path, bytes) of documents below ``root``, sorted; what is hidden at any level is skipped."""
    return [x for x in files.listed(spark, root) if _is_document(x[0])]


def _is_document(path: str) -> bool:
    return is_document_name(path) and not any(x.startswith(".") for x in path.split("/"))


def list_documents(spark: SparkSession, root: str) -> list[str]:
    """Paths of documents below ``root``, relative to it and sorted."""
    return [p for p, _ in document_files(spark, root)]


#: Files of a task, and about so many bytes of them; bytes of a batch that leaves it.
MOST, SIZE, BATCH = 512, 32 << 20, 4 << 20


def _runs(listing: list[tuple[str, int]], most: int = MOST, size: int = SIZE) -> list[list[str]]:
    """Paths of (path, bytes) pairs in runs of about ``size`` bytes, ``most`` files at most."""
    runs, held = [[]], 0
    for path, n in listing:
        if runs[-1] and (held + n > size or len(runs[-1]) >= most):
            runs.append([])
            held = 0
        runs[-1].append(path)
        held += n
    return runs


def _read(root: str, paths: list[str]) -> Iterator[tuple]:
    """Rows of SCHEMA."""
    for path in paths:
        try:
            with files.opened(f"{root}/{path}", "rb") as f:
                raw = f.read()
            yield path, raw.decode("utf-8"), len(raw), None
        except (OSError, UnicodeDecodeError) as e:
            yield path, None, 0, type(e).__name__


class _Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class _Reader(DataSourceReader):
    """Runs of files of about ``bytesPerTask`` bytes, ``filesPerTask`` at most."""

    def __init__(self, options: dict[str, str]):
        self.root = options["path"].rstrip("/")
        self.listing = options["listing"]
        self.most, self.size = int(options.get("filesPerTask", MOST)), int(options.get("bytesPerTask", SIZE))

    def partitions(self) -> list[InputPartition]:
        runs = _runs(json.loads(self.listing), self.most, self.size)
        self.listing = ""  # tasks need their own files alone
        return [_Files(r) for r in runs]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        return _read(self.root, partition.paths)


class ProvJsonSource(DataSource):
    """As ``read_corpus``: graph, body, n_bytes, read_error.

    As a format it takes the options ``path`` and ``listing`` (JSON of (path, bytes) pairs); without a
    listing it lists a mounted root itself.
    """

    @classmethod
    def name(cls) -> str:
        return "provjson"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options if "listing" in self.options else {**self.options, "listing": json.dumps(_mounted(self.options["path"]))})


def _mounted(root: str) -> list[tuple[str, int]]:
    """Documents of a tree in the reader's own file system; data sources run without a session."""
    if not files.is_local(root):
        raise ValueError(f"use read_corpus for {root}: it lists through Hadoop")
    return sorted(x for x in files.walked(files.plain(root)) if _is_document(x[0]))


def read_corpus(spark: SparkSession, root: str) -> DataFrame:
    """Documents of a corpus tree: graph (path below the root), body, n_bytes, read_error.

    Names are listed once, here, by the driver.  Stores that only Hadoop reads are scanned with Spark's
    binary reader, which leaves out names that begin with ``_``; such names are refused there.
    """
    found = document_files(spark, root)
    if files.is_local(root) or files.arrow_reads(root):
        return _scanned(spark, root.rstrip("/"), _runs(found))
    odd = [p for p, _ in found if any(x.startswith("_") for x in p.split("/"))]
    if odd:
        raise ValueError(f"names that begin with _ cannot be read from {root}: {odd[:5]}")
    base = files.qualified(spark, root) + "/"
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").load(root)
    path = F.substring(F.col("path"), len(base) + 1, 1 << 20)
    rows = rows.withColumn("graph", path).where(document_name(F.col("graph")) & ~F.col("graph").rlike("(^|/)[.]"))
    good = F.try_validate_utf8(F.col("content").cast("string"))
    return rows.select("graph", good.alias("body"), F.when(good.isNull(), 0).otherwise(F.col("length")).cast("long").alias("n_bytes"), F.when(good.isNull(), "UnicodeDecodeError").alias("read_error"))


def _scanned(spark: SparkSession, root: str, runs: list[list[str]]) -> DataFrame:
    """Rows of SCHEMA, one task for each run of files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for paths in (p for batch in batches for p in batch.column("paths").to_pylist()):
            rows, held = [], 0
            for row in _read(root, paths):
                rows.append(row)
                held += row[2]
                if held > BATCH:
                    yield _batch(rows)
                    rows, held = [], 0
            if rows:
                yield _batch(rows)

    dealt = spark.sparkContext.parallelize([(r,) for r in runs], len(runs))
    return spark.createDataFrame(dealt, "paths array<string>").mapInArrow(run, SCHEMA)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["graph", "body", "n_bytes", "read_error"])


def count_documents(spark: SparkSession, root: str) -> int:
    return len(document_files(spark, root))
