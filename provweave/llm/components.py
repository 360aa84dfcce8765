"""Connected components of links, by alternating large-star and small-star steps.

Each step is a minimum per node, pre-aggregated before its shuffle, joined back to the
links of the node; a node with very many links is split by the adaptive skew join.  Links never
reach the driver, only their number and a checksum per round.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from . import scratch


def _least(links: DataFrame) -> DataFrame:
    """u, v and the least neighbour or self of u."""
    return links.join(links.groupBy("u").agg(F.min("v").alias("m")), "u").withColumn("m", F.least("u", "m"))


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(id, component): every end of a link (a, b) with the least id that it reaches.

    Rows with a null end are ignored; without links the result is empty.
    """
    tasks = scratch.few(links.sparkSession)
    ends = links.select(F.col("a").cast("long").alias("u"), F.col("b").cast("long").alias("v")).where("u != v")
    now = scratch.table(ends.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links", tasks)
    seen = None
    for _ in range(most_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = _least(large.where("u > v"))
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).where("u > v").distinct()
        # counted while it is written
        told = Observation(f"round-{uuid.uuid4().hex}")
        small = small.observe(told, F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("u", "v").bitwiseAND(0xFFFFFFFF)), F.lit(0)).alias("sum"))
        before, now = now, scratch.table(small, "links", tasks)
        scratch.free(before)
        found = told.get
        if found == seen or not found["n"]:
            break
        seen = found
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("component"))).distinct()
