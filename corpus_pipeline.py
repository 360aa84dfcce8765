"""A corpus pipeline: five operators, each stage written as Parquet and read by the next.

Quality classifier, line dedup, near-dedup, mixing, packing.  Every stage but the last returns
the columns of ``documents``; each reads all that its predecessor kept.

Defined results: a null text is scored as an empty one, keeps its null through the line and
near-dedup stages and packs as its end token alone; a null source has no boilerplate and mixes
as a source of its own; rows with a null id are near-duplicates of nothing; rows of one id are one
document to near-dedup, kept or dropped together, and are mixed and packed row by row; an
empty table, or one of which no document is kept, gives empty results; further columns stay,
whatever their names, up to packing, which returns its own.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provweave.llm import lines, mixing, packing, q_quality, quality, scratch, setsketch

#: Lines in over this share of a source's documents, and in so many of them, are boilerplate.
LINE_RATIO, LINE_LEAST = 0.01, 5


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores ``q_quality.LEAST`` or more."""
    return quality.keep_good(docs, q_quality.learnt(spark, sf_dir), q_quality.LEAST)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the boilerplate lines of their source; near-duplicates count once for a line and are left to near-dedup."""
    copies = setsketch.near_duplicates(docs).select("doc_id", F.col("component_id").alias("copy_of")).distinct()
    return lines.drop_boilerplate(docs, "source", LINE_RATIO, LINE_LEAST, copies)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one of the smallest id, of each group of near-duplicates."""
    dropped = setsketch.near_duplicates(docs).where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(dropped, "doc_id", "left_anti").select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them."""
    return mixing.apply(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 4096 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), keep_ids=False)


STAGES = [
    ("quality_classifier", classify),
    ("line_dedup", dedup_lines),
    ("near_dedup", dedup_documents),
    ("mixing", mix),
    ("packing", pack),
]

#: A trained model and token ids are beyond SQL; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
