"""The corpus model: string dictionary and node templates, with dense ids, growing by appends."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from ..config import DEFAULT, ProvConfig
from ..functions.jsontext import canonical, quoted
from .shred import TALLY
from .stable import dense_ids


def string_occurrences(shredded: DataFrame) -> DataFrame:
    """(graph, seq, role, s): every string that the dictionary holds, where it stands."""
    return shredded.where("what = 'string'").select("graph", "seq", "role", F.col("text").alias("s"))


def _ordered(order: str) -> list:
    return {"lexical": [F.col("key")], "frequency": [F.col("n").desc(), F.col("key")], "first_seen": [F.col("graph"), F.col("seq"), F.col("key")]}[order]


def _dims(found: DataFrame, order: str, name: str, key: str, first: int, *more: str) -> DataFrame:
    """``found``: key, graph, seq and times (occurrences); ``more``: columns that are the same wherever the key is."""
    seen = found.groupBy("key").agg(F.sum("times").alias("n"), F.min(F.struct("graph", "seq")).alias("at"), *[F.first(c).alias(c) for c in more])
    seen = seen.select("key", "n", "at.graph", "at.seq", *more)
    return dense_ids(seen, _ordered(order), name, first).select(name, F.col("key").alias(key), "n", *more)


def dictionary(shredded: DataFrame, config: ProvConfig = DEFAULT, known: DataFrame | None = None) -> DataFrame:
    """(sid, s, n): distinct strings with dense ids; with ``known`` (sid, s) only the new ones, numbered on."""
    strings = shredded.where(F.col("what").isin("string", TALLY))
    found = strings.select(F.col("text").alias("key"), "graph", "seq", F.when(F.col("what") == TALLY, F.col("item_ord")).otherwise(1).alias("times"))
    first = 0
    if known is not None:
        found = found.join(known.select(F.col("s").alias("key")), "key", "left_anti")
        first = (known.agg(F.max("sid")).first()[0] if known.take(1) else -1) + 1
    return _dims(found, config.id_order, "sid", "s", first)


def node_records(shredded: DataFrame, config: ProvConfig = DEFAULT) -> DataFrame:
    """One row per node: template and residual as canonical text, residual null if it has no field.

    Fields split by membership in the volatile keys; both halves together are the record.  ``shared`` and
    ``own`` hold them as sorted (field, kv) pairs, kv being the member's text.
    """
    shared, own = halves(config)
    rows = shredded.where("route = 'node' AND what = 'item'").select(
        "graph", "path", "section", "item", "section_json", "item_json", "item_ord", "seq",
        shared.alias("shared"), own.alias("own"))
    return rows.select("*", object_text("shared").alias("template"), F.when(F.size("own") > 0, object_text("own")).alias("residual"), F.size("shared").alias("n_template"), F.size("own").alias("n_residual"))


def split_nodes(shredded: DataFrame) -> DataFrame:
    """As ``node_records``, of rows that hold SPLIT items: template and ``own``, no ``shared``."""
    own = F.transform("fields", lambda x: F.struct(x["field"].alias("field"), F.concat(x["field_json"], F.lit(":"), x["json"]).alias("kv")))
    return shredded.where("route = 'node' AND what = 'item'").select("graph", "path", "section", "item", "section_json", "item_json", "item_ord", "seq", F.col("text").alias("template"), own.alias("own"))


@F.arrow_udf(ArrayType(StructType([StructField("field", StringType()), StructField("kv", StringType())])))
def template_pairs(texts: pa.Array) -> pa.Array:
    """Sorted (field, kv) pairs of templates."""
    pairs = [[{"field": k, "kv": f"{quoted(k)}:{canonical(v)}"} for k, v in sorted(json.loads(x).items())] for x in texts.to_pylist()]
    return pa.array(pairs, pa.list_(pa.struct([("field", pa.string()), ("kv", pa.string())])))


def halves(config: ProvConfig) -> tuple[Column, Column]:
    """Sorted (field, kv) pairs of the fields that are shared, and of the volatile ones."""
    volatile = sorted(config.volatile_keys)
    pairs = lambda keep: F.transform(F.filter("fields", keep), lambda x: F.struct(x["field"].alias("field"), F.concat(x["field_json"], F.lit(":"), x["json"]).alias("kv")))
    return pairs(lambda x: ~x["field"].isin(*volatile)), pairs(lambda x: x["field"].isin(*volatile))


def object_text(pairs: Column | str) -> Column:
    """Canonical object text of sorted (field, kv) pairs."""
    return F.concat(F.lit("{"), F.array_join(F.transform(pairs, lambda x: x["kv"]), ","), F.lit("}"))


def templates(nodes: DataFrame, config: ProvConfig = DEFAULT, known: DataFrame | None = None) -> DataFrame:
    """(tid, template, n, shared): distinct templates with dense ids; identity is the text, whatever the section."""
    more = [c for c in ("shared",) if c in nodes.columns]
    found = nodes.select(F.col("template").alias("key"), "graph", "seq", *more, F.lit(1).alias("times"))
    first = 0
    if known is not None:
        found = found.join(known.select(F.col("template").alias("key")), "key", "left_anti")
        first = (known.agg(F.max("tid")).first()[0] if known.take(1) else -1) + 1
    made = _dims(found, config.id_order, "tid", "template", first, *more)
    return made if more else made.withColumn("shared", template_pairs("template"))
