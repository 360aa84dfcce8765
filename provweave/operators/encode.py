"""Facts: shredded rows joined with the model's dimensions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, ProvConfig

DOC = ["graph", "path"]
ITEM = [*DOC, "section", "item"]


def rel_fields(shredded: DataFrame, config: ProvConfig = DEFAULT) -> DataFrame:
    """The relation schema as rows (section, field, pos); a few dozen."""
    rows = [F.struct(F.lit(r).alias("section"), F.lit(f).alias("field"), F.lit(i).alias("pos")) for r, fields in config.rel_schema.items() for i, f in enumerate(fields)]
    one = shredded.sparkSession.range(0, 1, 1, 1)  # made by the JVM: rows from Python start workers
    return one.select(F.inline(F.array(*rows))) if rows else one.select(F.lit("").alias("section"), F.lit("").alias("field"), F.lit(0).alias("pos")).where("false")


def edge_cells(shredded: DataFrame, config: ProvConfig = DEFAULT) -> DataFrame:
    """Fields of edges in long form; ``pos`` is the schema column, null for an extra."""
    cells = shredded.where("route = 'edge' AND what = 'item'").select(*ITEM, "item_ord", F.inline("fields"))
    return cells.join(F.broadcast(rel_fields(shredded, config)), ["section", "field"], "left")


def with_ids(rows: DataFrame, dictionary: DataFrame, text: str, name: str) -> DataFrame:
    """``rows`` with the dictionary id of a string column; null where the string is null.

    Rows without a string take no part in the join, or they would all meet in one task.
    """
    ids = dictionary.select(F.col("s").alias(text), F.col("sid").alias(name))
    found = rows.where(F.col(text).isNotNull()).join(ids, text, "left")
    return found.unionByName(rows.where(F.col(text).isNull()).withColumn(name, F.lit(None).cast("long")))


def edge_facts(shredded: DataFrame, dictionary: DataFrame, config: ProvConfig = DEFAULT) -> DataFrame:
    """Edge fields encoded: string cells as ids, all other values as canonical text."""
    cells = edge_cells(shredded, config).withColumn("cell", F.when((F.col("kind") == "s") & F.col("pos").isNotNull(), F.col("text")))
    return with_ids(cells, dictionary, "cell", "sid").select(*ITEM, "item_ord", "field", "field_json", "pos", "kind", "sid", F.when(F.col("sid").isNull(), F.col("json")).alias("json"))


def edge_table(shredded: DataFrame, relation: str, config: ProvConfig = DEFAULT) -> DataFrame:
    """Wide table of one relation: a struct (kind, text, json) per schema field, null where absent, and extras.

    The fields of an edge stand in its row, so this is a projection.
    """
    rows = shredded.where((F.col("section") == relation) & (F.col("route") == "edge") & (F.col("what") == "item"))
    names = config.rel_schema[relation]
    cell = F.map_from_entries(F.transform("fields", lambda x: F.struct(x["field"], F.struct(x["kind"].alias("kind"), x["text"].alias("text"), x["json"].alias("json")))))
    extras = F.map_from_entries(F.transform(F.filter("fields", lambda x: ~x["field"].isin(*names)), lambda x: F.struct(x["field"], x["json"])))
    return rows.select(*ITEM, "item_ord", cell.alias("cells"), extras.alias("extras")).select(*ITEM, "item_ord", *[F.try_element_at("cells", F.lit(f)).alias(f) for f in names], "extras")


def node_facts(nodes: DataFrame, dictionary: DataFrame, templates: DataFrame) -> DataFrame:
    """Nodes encoded: id of the name, id of the template, residual as pairs."""
    named = with_ids(nodes.select(*ITEM, "section_json", "item_json", "item_ord", "template", "own"), dictionary, "item", "sid")
    return named.join(templates.select("template", "tid"), "template").drop("template")
