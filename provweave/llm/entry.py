"""The queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

#: Modules with a NAME, a query(spark, sf_dir) and an ORACLE_SQL (None where SQL cannot express it).
MODULES = ("q_mix", "q_quality", "q_pack", "q_rules", "q_substring", "q_pii", "q_forest", "q_lines", "q_setsketch", "q_suffix")


def _modules():
    return [import_module(f"{__package__}.{m}") for m in MODULES]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {m.NAME: m.query for m in _modules()}


def oracle_sql() -> dict[str, str]:
    return {m.NAME: m.ORACLE_SQL for m in _modules() if m.ORACLE_SQL}
