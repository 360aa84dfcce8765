"""Mixing sources to target weights, with DataFrame functions only.

Every document gets a hash-random key, the hex MD5 of a seed and its id.  A source's
documents in key order are a random order; fixed key prefixes cut that order into
``16 ** PREFIX`` ranges, so a hot source is spread over many tasks.  Word counts are
summed in two levels: a prefix sum over the range totals of each source finds the one
range that holds the source's cut, and only that range is summed row by row.  A
source's decision is then one row (whole passes, cut key, words left at the cut), and
applying it to documents needs no shuffle of texts.

Defined results: a null text has size 0; a null source is a source of its own, last in
order; a null id is an id like any other; equal rows (same source, id and size) share
the words left at the cut evenly; an empty table gives an empty result; further columns
of the input are ignored by ``plan`` and kept by ``apply``.  The table of sources is
ordered in one task: it has one row per source of the mixture.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scratch, text

#: Hex digits of the key that name a range.
PREFIX = 3


def mix_key(doc_id: Column, seed: int) -> Column:
    """Hash-random key of a document id."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))))


def _named(source: Column) -> Column:
    """A source as a join key that tells null from every string."""
    return F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), source.cast("string")))


def targets(sized: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """Sources with their size, weight and target by water filling.

    Below the water level ``l`` a target is ``l * weight``; a source whose cap ``most *
    size`` lies under that stops there.  With sources in order of cap / weight, the level
    is (budget - caps of those that stop) / (weights of the rest) at the first source
    that does not stop.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_cap = Window.orderBy("ratio", "source")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1)
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("weight", weight)
    sources = sources.withColumn("cap", F.lit(float(most)) * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("weight"))
    everything = Window.partitionBy()
    before = F.coalesce(F.sum("cap").over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(by_cap.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    sources = sources.withColumn("level", (F.lit(float(share)) * F.sum("source_size").over(everything) - before) / rest)
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(everything)["level"]
    sources = sources.withColumn("at", F.coalesce(level, F.lit(float("inf"))))
    return sources.select("source", "source_size", F.least("cap", F.col("at") * F.col("weight")).alias("target"))


def plan(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 17) -> tuple[DataFrame, DataFrame]:
    """(sized documents, cuts).

    ``docs`` needs doc_id, text, source.  The first table has doc_id, source, size, key; the
    second one row per source: source_size, target, passes (whole epochs), cut_key,
    cut_id, cut_size (the document at which the last, partial pass ends; null without one)
    and cut_words (words taken there).
    """
    sized = scratch.table(docs.select("doc_id", F.col("source").cast("string").alias("source"), text.n_words(F.col("text")).alias("size"), mix_key(F.col("doc_id"), seed).alias("key")), "sized")
    goal = targets(sized, weights, share, most)
    goal = goal.withColumn("passes", F.when(F.col("source_size") > 0, F.floor(F.floor("target") / F.col("source_size"))).otherwise(0).cast("long"))
    goal = goal.withColumn("left", (F.floor("target") - F.col("passes") * F.col("source_size")).cast("long"))
    goal = scratch.table(goal.withColumn("named", _named(F.col("source"))), "goal")

    rows = sized.withColumn("named", _named(F.col("source"))).withColumn("range", F.substring("key", 1, PREFIX))
    totals = rows.groupBy("named", "range").agg(F.sum("size").alias("n"))
    ends = F.sum("n").over(Window.partitionBy("named").orderBy("range"))
    holding = totals.withColumn("end", ends).join(goal.select("named", "left"), "named").where((F.col("left") >= F.col("end") - F.col("n")) & (F.col("left") < F.col("end")))
    holding = holding.select("named", "range", (F.col("left") - (F.col("end") - F.col("n"))).alias("left"))

    inside = rows.join(holding, ["named", "range"]).groupBy("named", "key", "doc_id", "size", "left").agg(F.count("*").alias("copies"))
    inside = inside.withColumn("whole", F.col("size") * F.col("copies"))
    order = Window.partitionBy("named").orderBy("key", F.col("doc_id").asc_nulls_first(), "size")
    inside = inside.withColumn("end", F.sum("whole").over(order))
    cut = inside.where((F.col("left") >= F.col("end") - F.col("whole")) & (F.col("left") < F.col("end")))
    cut = cut.select("named", F.col("key").alias("cut_key"), F.col("doc_id").alias("cut_id"), F.col("size").alias("cut_size"), F.floor((F.col("left") - (F.col("end") - F.col("whole"))) / F.col("copies")).cast("long").alias("cut_words"))
    return sized, scratch.table(goal.drop("left").join(cut, "named", "left"), "cuts")


def taken(cuts: DataFrame, docs: DataFrame) -> DataFrame:
    """``docs`` (with source, key, doc_id, size) and the words the mix takes of each: ``taken``."""
    key, at = F.struct("key", "doc_id", "size"), F.struct(F.col("cut_key").alias("key"), F.col("cut_id").alias("doc_id"), F.col("cut_size").alias("size"))
    last = F.when(F.col("cut_key").isNull(), 0).when(key < at, F.col("size")).when(key == at, F.col("cut_words")).otherwise(0)
    joined = docs.withColumn("named", _named(F.col("source"))).join(cuts.drop("source"), "named")
    return joined.withColumn("taken", (F.col("passes") * F.col("size") + last).cast("long"))


def apply(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: each document as often as it is taken, with the columns of ``docs``.

    A document that the cut takes in part counts as taken when it has at least half of its
    words there, so that texts stay whole.
    """
    seed = options.get("seed", 17)
    _, cuts = plan(docs, **options)
    own = docs.select(F.struct("*").alias("row"), "doc_id", F.col("source").cast("string").alias("source"), text.n_words(F.col("text")).alias("size"), mix_key(F.col("doc_id"), seed).alias("key"))
    times = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + 0.5)).otherwise(F.lit(1)).cast("int")
    rows = taken(cuts, own).select("row", F.explode(F.array_repeat(F.lit(0), times)))
    return rows.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
