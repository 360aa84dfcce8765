"""Counts per document and corpus, verification, and size metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, ProvConfig
from ..functions.jsontext import prov_canonical
from .model import halves, object_text


def edge_counts(shredded: DataFrame, config: ProvConfig = DEFAULT) -> DataFrame:
    """(graph, orig_edges): members of relation sections, also of those that are lists or hold odd members."""
    sections = shredded.where("what = 'section' AND kind IN ('o', 'a')").where(F.col("section").isin(*config.rel_schema))
    return sections.groupBy("graph").agg(F.sum("item_ord").cast("long").alias("orig_edges"))


def graph_stats(shredded: DataFrame, nodes: DataFrame | None = None, config: ProvConfig = DEFAULT) -> DataFrame:
    """Per document: nodes, edges, distinct templates, nodes with a residual, ratios.

    One pass over the rows and one exchange, so nothing needs to be stored for it; ``nodes`` are
    taken from there if they are at hand already.  Templates are told apart by a 128-bit digest, so that no text travels.
    """
    shared, own = halves(config)
    root = (F.col("what") == "doc") & (F.size("path") == 0)
    edge = (F.col("what") == "section") & F.col("kind").isin("o", "a") & F.col("section").isin(*config.rel_schema)
    node = (F.col("what") == "item") & (F.col("route") == "node") if nodes is None else F.lit(False)
    digest = lambda text: F.unhex(F.md5(text))
    rows = shredded.where(root | edge | node).select(
        "graph", root.alias("root"), F.when(edge, F.col("item_ord")).alias("edges"), node.alias("node"),
        F.when(node, digest(object_text(shared))).alias("template"), (node & (F.size(own) > 0)).alias("own"))
    if nodes is not None:
        rows = rows.unionByName(nodes.select("graph", F.lit(False).alias("root"), F.lit(None).cast("int").alias("edges"), F.lit(True).alias("node"), digest(F.col("template")).alias("template"), F.col("residual").isNotNull().alias("own")))
    found = rows.groupBy("graph").agg(
        F.max("root").alias("root"), F.count_if("node").alias("orig_nodes"), F.coalesce(F.sum("edges"), F.lit(0)).cast("long").alias("orig_edges"),
        F.size(F.collect_set("template")).cast("long").alias("comp_nodes"), F.count_if("own").alias("residual_nodes"))
    ratio = F.col("comp_nodes") / F.greatest(F.col("orig_nodes"), F.lit(1))
    return found.where("root").select("graph", "orig_nodes", "orig_edges", "comp_nodes", F.col("orig_edges").alias("comp_edges"), "residual_nodes", ratio.alias("nodes_ratio"), F.lit(1.0).alias("edges_ratio"))


def corpus_totals(stats: DataFrame, nodes: DataFrame, dictionary: DataFrame, verified: DataFrame | None = None) -> DataFrame:
    """One row for the corpus; also for an empty one.  lossless and roundtrip_failures are null where nothing was verified."""
    total = stats.agg(F.count("*").alias("graphs"), *[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("orig_nodes", "orig_edges", "residual_nodes")])
    used = nodes.agg(F.countDistinct(F.md5("template")).alias("total_supernodes"))
    strings = dictionary.agg(F.count("*").alias("dict_strings"))
    one = F.lit(1).alias("one")
    rows = total.select("*", one).join(used.select("*", one), "one").join(strings.select("*", one), "one").drop("one")
    rows = rows.withColumn("node_dedup_ratio", F.col("total_supernodes") / F.greatest(F.col("orig_nodes"), F.lit(1)))
    if verified is None:
        return rows.withColumns({"lossless": F.lit(None).cast("boolean"), "roundtrip_failures": F.lit(None).cast("long")})
    summary = verify_summary(verified).select("lossless", F.col("failures").alias("roundtrip_failures"), F.lit(1).alias("one"))
    return rows.withColumn("one", F.lit(1)).join(summary, "one").drop("one")


def digest(text: str) -> Column:
    """Length and SHA-256 of a text; null for null."""
    return F.concat(F.octet_length(text).cast("string"), F.lit(":"), F.sha2(F.col(text), 256))


def verify(originals: DataFrame, rebuilt: DataFrame) -> DataFrame:
    """(graph, state): ok, differs, missing (no reconstruction) or malformed (no document).

    ``originals``: graph, body; ``rebuilt``: graph, text (canonical).  Texts are compared by length and
    SHA-256, so that only these travel.
    """
    left = originals.select("graph", prov_canonical("body").alias("text")).select("graph", digest("text").alias("want"))
    rows = left.join(rebuilt.select("graph", digest("text").alias("have"), F.lit(True).alias("there")), "graph", "left")
    state = F.when(F.col("there").isNull(), "missing").when(F.col("want").isNull(), "malformed").when(F.col("want") == F.col("have"), "ok").otherwise("differs")
    return rows.select("graph", state.alias("state"))


def verify_summary(verified: DataFrame) -> DataFrame:
    """checked, failures, lossless; documents without a reconstruction fail and are not checked."""
    failed = F.count_if(F.col("state") != "ok")
    return verified.agg(F.count_if(F.col("state").isin("ok", "differs")).alias("checked"), failed.alias("failures"), (failed == 0).alias("lossless"))


def mismatches(verified: DataFrame, limit: int = 20) -> DataFrame:
    """The first failures by name."""
    return verified.where("state != 'ok'").orderBy("graph").limit(limit)


def reduction_pct(compressed: Column, original: Column) -> Column:
    """(1 - compressed / original) * 100; 0 without an original."""
    return F.when(original > 0, (1 - compressed / original) * 100).otherwise(F.lit(0.0))


SUMS = ("input_bytes", "minified_bytes", "payload_bytes", "graphs", "orig_nodes", "orig_edges", "compress_s", "decompress_s")


def pooled(results: DataFrame, name: str = "pooled") -> DataFrame:
    """Rows per corpus and their grand total: sums, greatest memory, ratio from summed bytes."""
    aggs = [F.sum(c).alias(c) for c in SUMS if c in results.columns]
    aggs += [F.max("peak_mb").alias("peak_mb")] if "peak_mb" in results.columns else []
    aggs += [F.every("lossless").alias("lossless")] if "lossless" in results.columns else []
    rows = results.rollup("corpus").agg(*aggs).withColumn("corpus", F.coalesce("corpus", F.lit(name)))
    return rows.withColumn("reduction", reduction_pct(F.col("payload_bytes"), F.col("input_bytes")))


def scaling_fit(results: DataFrame, x: str = "input_bytes", y: str = "compress_s") -> DataFrame:
    """Least squares of time over size with R2; null with under three sizes."""
    enough = F.countDistinct(x) >= 3
    return results.agg(*[F.when(enough, f(y, x)).alias(n) for f, n in ((F.regr_slope, "slope"), (F.regr_intercept, "intercept"), (F.regr_r2, "r2"))])


# Display names of known corpora.
LABELS = {
    "prov-deepseek-chat": "DeepSeek-Chat",
    "prov-gpt-5-nano": "GPT-5-Nano",
    "google_gemini-2.5-flash": "Gemini-2.5-Flash",
    "meta-llama_llama-3.3-70b-instruct": "Llama-3.3-70B",
    "qwen_qwen-2.5-72b-instruct": "Qwen-2.5-72B",
    "z-ai_glm-4.6": "GLM-4.6",
}
# End of fixed values.


def display_label(mode: Column) -> Column:
    """A name for people: a known one, else the corpus prefix off and a capital first, else as it is."""
    known = F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv])[mode]
    rest = F.substring(mode, len("prov_corpus_") + 1, 1 << 20)
    return F.coalesce(known, F.when(mode.startswith("prov_corpus_"), F.concat(F.upper(F.substring(rest, 1, 1)), F.lower(F.substring(rest, 2, 1 << 20)))).otherwise(mode))
