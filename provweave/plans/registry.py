"""Queries by name, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str):
    """Register a function (spark, sf_dir) -> DataFrame with the SQL of its result."""

    def put(f):
        QUERIES[name], ORACLE[name] = f, sql
        return f

    return put
