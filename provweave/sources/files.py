"""Files by path or URI, through whatever file system holds them.

The driver lists, sizes and deletes through Hadoop's file systems, so any store that Spark reads will
do.  Executors open single files: local and mounted paths directly, other schemes through
Arrow's file systems.
"""

from __future__ import annotations

import contextlib
import os
from collections.abc import Iterator
from typing import BinaryIO
from urllib.parse import urlparse

from pyspark.sql import SparkSession


def is_local(path: str) -> bool:
    """Whether a path is a plain one or a ``file:`` URI."""
    return urlparse(path).scheme in ("", "file")


def plain(path: str) -> str:
    """The local path of a ``file:`` URI or of a plain path."""
    return urlparse(path).path if path.startswith("file:") else path


def hadoop(spark: SparkSession, path: str):
    """(Hadoop path, its file system)."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path if not is_local(path) else f"file://{os.path.abspath(plain(path))}")
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    where, fs = hadoop(spark, path)
    return fs.exists(where)


def delete(spark: SparkSession, path: str) -> None:
    where, fs = hadoop(spark, path)
    fs.delete(where, True)


def qualified(spark: SparkSession, path: str) -> str:
    """The full URI of a path, without a slash at its end."""
    where, fs = hadoop(spark, path)
    return fs.makeQualified(where).toString().rstrip("/")


def listed(spark: SparkSession, root: str) -> list[tuple[str, int]]:
    """(path relative to the root, bytes) of all files below it, sorted; nothing for a missing root.

    A mounted root is walked directly, which takes microseconds a file and not several calls into the JVM.
    """
    if is_local(root):
        return sorted(walked(plain(root)))
    where, fs = hadoop(spark, root)
    if not fs.exists(where):
        return []
    base = fs.getFileStatus(where).getPath().toUri().getPath().rstrip("/") + "/"
    found, files = [], fs.listFiles(where, True)
    while files.hasNext():
        each = files.next()
        found.append((each.getPath().toUri().getPath().removeprefix(base), each.getLen()))
    return sorted(found)


def walked(root: str) -> Iterator[tuple[str, int]]:
    """``listed`` for a local root, unsorted; files that vanish meanwhile count nothing."""
    for folder, _, names in os.walk(root):
        for name in names:
            path = os.path.join(folder, name)
            with contextlib.suppress(FileNotFoundError):
                yield os.path.relpath(path, root).replace(os.sep, "/"), os.path.getsize(path)


def opened(path: str, mode: str) -> BinaryIO:
    """A file for reading (``rb``) or writing (``wb``) on an executor; folders above it are made."""
    if is_local(path):
        if mode == "wb":
            os.makedirs(os.path.dirname(plain(path)), exist_ok=True)
        return open(plain(path), mode)
    from pyarrow import fs

    store, inside = fs.FileSystem.from_uri(path)
    if mode == "wb":
        store.create_dir(os.path.dirname(inside), recursive=True)
        return store.open_output_stream(inside)
    return store.open_input_stream(inside)


def arrow_reads(root: str) -> bool:
    """Whether Arrow has a file system for a URI."""
    from pyarrow import ArrowException, fs

    try:
        fs.FileSystem.from_uri(root)
    except (ArrowException, OSError, ValueError):
        return False
    return True


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small text from the driver."""
    where, fs = hadoop(spark, path)
    out = fs.create(where, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def get_text(spark: SparkSession, path: str) -> str:
    """Read a small text file on the driver."""
    where, fs = hadoop(spark, path)
    source = fs.open(where)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(source)).decode()
    finally:
        source.close()


def one_file(spark: SparkSession, folder: str, path: str, head: str = "") -> None:
    """The part files that Spark's writer left in ``folder``, end to end in one file; the folder goes."""
    joined(spark, path, [f"{head}\n" if head else "", (folder, 0)])


def joined(spark: SparkSession, path: str, pieces: list[str | tuple[str, int]]) -> None:
    """One file of small texts and (folder of part files, bytes left out at their end); the folders go.

    Bytes pass through the driver's JVM as a stream; no row does.
    """
    where, fs = hadoop(spark, path)
    folders = [hadoop(spark, x[0])[0] for x in pieces if isinstance(x, tuple)]
    out = fs.create(where, True)
    try:
        for piece in pieces:
            if isinstance(piece, str):
                out.write(bytearray(piece.encode()))
                continue
            parts = sorted((s.getPath().toString(), s.getLen()) for s in fs.listStatus(hadoop(spark, piece[0])[0]) if s.getPath().getName().startswith("part-"))
            left = max(0, sum(n for _, n in parts) - piece[1])
            for name, n in parts:
                source = fs.open(spark._jvm.org.apache.hadoop.fs.Path(name))
                spark._jvm.org.apache.commons.io.IOUtils.copyLarge(source, out, 0, min(n, left))
                source.close()
                left -= min(n, left)
    finally:
        out.close()
    for each in folders:
        fs.delete(each, True)
