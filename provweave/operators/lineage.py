"""Lineage over shredded relations: directed edges and what a node goes back to."""

from __future__ import annotations

import itertools
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, ProvConfig
from .shred import BATCH

#: Relations that say where something comes from: from the first field to the second.
TRACED = ("used", "wasGeneratedBy", "wasDerivedFrom", "wasInformedBy", "wasAttributedTo", "wasAssociatedWith", "specializationOf")

#: Documents whose links are Python objects at once.
DOCUMENTS = 500


def edges(shredded: DataFrame, config: ProvConfig = DEFAULT, relations: tuple[str, ...] = TRACED, distinct: bool = True) -> DataFrame:
    """(graph, source, target) of traced relations whose two ends are names; each once if ``distinct``."""
    ends = F.create_map(*[F.lit(x) for r in relations for x in (r, config.rel_schema[r][0])])[F.col("section")]
    others = F.create_map(*[F.lit(x) for r in relations for x in (r, config.rel_schema[r][1])])[F.col("section")]
    rows = shredded.where("route = 'edge' AND what = 'item'").where(F.col("section").isin(*relations)).withColumns({"from": ends, "to": others})
    pick = lambda end: F.get(F.filter("fields", lambda x: (x["field"] == F.col(end)) & (x["kind"] == "s")), F.lit(0))["text"]
    wide = rows.select("graph", pick("from").alias("source"), pick("to").alias("target"))
    found = wide.where("source IS NOT NULL AND target IS NOT NULL").select("graph", "source", "target")
    return found.distinct() if distinct else found


def reachable(links: DataFrame, starts: DataFrame | Column, most: int = 50) -> DataFrame:
    """(graph, source, reached, hops): least hops from each start, breadth first.

    ``starts``: (graph, source), or a condition on links whose sources are starts, which saves a second pass.
    Links do not leave their document, which one worker has parsed whole already, so its links meet in one
    row and are followed there: one exchange however many hops, and nothing is stored between them.
    """
    if isinstance(starts, Column):
        rows = links.select("graph", "source", "target", F.coalesce(starts, F.lit(False)).alias("start"))
    else:
        rows = links.select("graph", "source", "target", F.lit(False).alias("start")).unionByName(starts.select("graph", "source", F.lit(None).cast("string").alias("target"), F.lit(True).alias("start")))
    whole = rows.groupBy("graph").agg(F.collect_set(F.struct("source", "target", "start")).alias("links"))

    def follow(links: list[dict]) -> Iterator[tuple[str, str, int]]:
        targets = defaultdict(set)
        for x in links:
            if x["target"] is not None:
                targets[x["source"]].add(x["target"])
        for start in {x["source"] for x in links if x["start"]}:
            seen, front = {start}, {start}
            for hop in range(1, most + 1):
                front = {t for s in front for t in targets.get(s, ())} - seen
                if not front:
                    break
                seen |= front
                yield from ((start, t, hop) for t in front)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = ((g, *x) for batch in batches for i in range(0, batch.num_rows, DOCUMENTS) for part in [batch.slice(i, DOCUMENTS)] for g, e in zip(part.column("graph").to_pylist(), part.column("links").to_pylist()) for x in follow(e))
        while some := list(itertools.islice(found, BATCH)):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some), (pa.string(), pa.string(), pa.string(), pa.int32()))], ["graph", "source", "reached", "hops"])

    return whole.mapInArrow(run, "graph string, source string, reached string, hops int")
