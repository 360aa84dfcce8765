"""One query per operator over the derived corpora, with the SQL that checks it.

The Spark side makes JSON texts, shreds them and runs the operator; the SQL computes the
expected relation straight from the star-schema tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT, SIDECAR_NAMES, SIDECAR_SUFFIX, VOLATILE_ATTR_KEYS, ProvConfig
from ..functions.jsontext import prov_canonical, prov_minified_len
from ..operators import decode, encode, lineage, model, shred, stats, views
from ..operators.stable import stable
from ..sources.provjson import document_name
from . import codec, corpora, stored
from .registry import ORACLE, QUERIES, query

LEXICAL = ProvConfig(id_order="lexical")
#: What a query needs of the shredder: nodes or edges, all but strings.
ITEMS, FACTS = ("item",), ("doc", "section", "item")
NODE_SECTIONS = DEFAULT.node_sections


def _rows(spark: SparkSession, sf_dir: str, corpus: str = "commerce", want=shred.WHATS, sections=None) -> DataFrame:
    return shred.shred(stored.corpus(spark, sf_dir, corpus), want=want, sections=sections)


def _nodes(spark: SparkSession, sf_dir: str, corpus: str = "commerce") -> DataFrame:
    return model.node_records(_rows(spark, sf_dir, corpus, ITEMS, NODE_SECTIONS))


_SIDE = ", ".join(f"'{n}'" for n in sorted(SIDECAR_NAMES))
_LINES = "(SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus) AS rn FROM lineitem)"


@query("o02_sidecar_filter", f"""
WITH n AS (SELECT 'corpus/' || page_id || '/' || CASE page_id % 6 WHEN 0 THEN 'task.json' WHEN 1 THEN 'task.transcript.json' WHEN 2 THEN 'manifest.json'
  WHEN 3 THEN 'my_corpus_manifest.json' WHEN 4 THEN 'checksums.sha256' ELSE '_x.json' END AS path FROM pages)
SELECT path, NOT (regexp_extract(path, '[^/]*$') IN ({_SIDE}) OR suffix(path, '{SIDECAR_SUFFIX}')) AS is_document FROM n""")  # fmt: skip
def sidecar_filter(spark, sf_dir):
    names = F.element_at(F.array(*map(F.lit, ("task.json", "task.transcript.json", "manifest.json", "my_corpus_manifest.json", "checksums.sha256", "_x.json"))), (F.col("page_id") % 6 + 1).cast("int"))
    paths = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.concat(F.lit("corpus/"), F.col("page_id").cast("string"), F.lit("/"), names).alias("path"))
    return paths.withColumn("is_document", document_name(F.col("path")))


@query("o05_tolerant_read", """
SELECT CASE WHEN event_id % 5 = 0 THEN 'malformed' WHEN event_id % 5 = 1 THEN 'top_level_string' WHEN event_id % 5 = 2 THEN 'missing' ELSE 'good' END AS outcome, count(*) AS n
FROM events GROUP BY 1""")
def tolerant_read(spark, sf_dir):
    e = F.col("event_id") % 5
    body = F.when(e == 0, F.concat(F.col("props"), F.lit("}"))).when(e == 1, F.concat(F.lit('"'), "event_type", F.lit('"'))).when(e == 2, F.lit(None)).otherwise(F.col("props"))
    rows = shred.shred(spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").cast("string").alias("graph"), body.alias("body")))
    outcome = F.when(F.col("what") == "doc", "good").otherwise(F.regexp_extract("text", "^[a-z_]+", 0))
    return rows.where("what = 'error' OR what = 'doc'").groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))


@query("o17_section_route", f"""
SELECT 'entity' AS section, 'node' AS route, (SELECT count(*) FROM orders) AS sections, (SELECT count(*) FROM orders) + (SELECT count(DISTINCT (l_orderkey, l_partkey)) FROM lineitem) AS members
UNION ALL SELECT 'activity', 'node', count(*), count(*) FROM orders
UNION ALL SELECT 'agent', 'node', (SELECT count(*) FROM orders), (SELECT count(*) FROM orders) + (SELECT count(DISTINCT (l_orderkey, l_suppkey)) FROM lineitem)
UNION ALL SELECT 'used', 'edge', count(DISTINCT l_orderkey), count(*) FROM lineitem
UNION ALL SELECT 'wasAttributedTo', 'edge', count(DISTINCT l_orderkey), count(DISTINCT (l_orderkey, l_partkey, l_suppkey)) FROM lineitem
UNION ALL SELECT 'wasGeneratedBy', 'edge', count(*), count(*) FROM orders
UNION ALL SELECT 'wasAssociatedWith', 'edge', count(*), count(*) FROM orders""")
def section_route(spark, sf_dir):
    return _rows(spark, sf_dir, want=["section"]).where("what = 'section'").groupBy("section", "route").agg(F.count("*").alias("sections"), F.sum("item_ord").cast("long").alias("members"))


@query("o18_section_validity", """
SELECT CASE WHEN bad THEN 'other' ELSE 'node' END AS route, count(*) AS sections, CAST(sum(n) AS BIGINT) AS members
FROM (SELECT conv_id, conv_id % 3 = 0 AS bad, count(*) AS n FROM conversations GROUP BY conv_id) GROUP BY 1""")
def section_validity(spark, sf_dir):
    t = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    odd = (F.col("conv_id") % 3 == 0) & (F.col("turn") == F.min("turn").over(corpora.Window.partitionBy("conv_id")))
    t = t.withColumn("m", corpora.member(F.concat(F.lit("t"), F.col("turn").cast("string")), F.when(odd, F.lit('"text"')).otherwise(F.lit("{}"))))
    docs = t.groupBy(F.col("conv_id").cast("string").alias("graph")).agg(F.concat(F.lit('{"entity":{'), F.array_join(F.collect_list("m"), ","), F.lit("}}")).alias("body"))
    return shred.shred(docs, want=["section"]).where("what = 'section'").groupBy("route").agg(F.count("*").alias("sections"), F.sum("item_ord").cast("long").alias("members"))


@query("o19_split_record", """
WITH p AS (SELECT count(DISTINCT (l_orderkey, l_partkey)) AS n FROM lineitem), o AS (SELECT count(*) AS n FROM orders), s AS (SELECT count(DISTINCT (l_orderkey, l_suppkey)) AS n FROM lineitem)
SELECT 'entity' AS section, 3 * p.n + 3 * o.n AS template_fields, p.n + 2 * o.n AS residual_fields FROM p, o
UNION ALL SELECT 'activity', o.n, o.n FROM o UNION ALL SELECT 'agent', 2 * o.n + s.n, 0 FROM o, s""")
def split_record(spark, sf_dir):
    return _nodes(spark, sf_dir).groupBy("section").agg(F.sum("n_template").cast("long").alias("template_fields"), F.sum("n_residual").cast("long").alias("residual_fields"))


@query("o20_schema_extra", "SELECT 'ex:props' AS field, count(*) AS extras FROM events")
def schema_extra(spark, sf_dir):
    return encode.edge_cells(_rows(spark, sf_dir, "telemetry", ITEMS)).where("pos IS NULL").groupBy("field").agg(F.count("*").alias("extras"))


@query("o21_cell_kind", """
WITH u AS (SELECT count(*) AS n FROM lineitem), t AS (SELECT count(DISTINCT (l_orderkey, l_partkey, l_suppkey)) AS n FROM lineitem), o AS (SELECT count(*) AS n FROM orders)
SELECT 'used' AS section, f AS field, CASE f WHEN 'prov:time' THEN 'o' ELSE 's' END AS kind, n FROM u, (VALUES ('prov:activity'), ('prov:entity'), ('prov:role'), ('prov:time')) v(f)
UNION ALL SELECT 'wasAttributedTo', f, CASE f WHEN 'prov:role' THEN 'absent' ELSE 's' END, n FROM t, (VALUES ('prov:entity'), ('prov:agent'), ('prov:role')) v(f)
UNION ALL SELECT 'wasGeneratedBy', f, CASE WHEN f IN ('prov:role', 'prov:time') THEN 'absent' ELSE 's' END, n FROM o, (VALUES ('prov:entity'), ('prov:activity'), ('prov:role'), ('prov:time')) v(f)
UNION ALL SELECT 'wasAssociatedWith', f, CASE WHEN f IN ('prov:plan', 'prov:role') THEN 'absent' ELSE 's' END, n FROM o, (VALUES ('prov:activity'), ('prov:agent'), ('prov:plan'), ('prov:role')) v(f)""")
def cell_kind(spark, sf_dir):
    rows = stable(_rows(spark, sf_dir, want=ITEMS, sections=DEFAULT.rel_schema))
    edges = rows.where("what = 'item' AND route = 'edge'").groupBy("section").agg(F.count("*").alias("edges"))
    cells = encode.edge_cells(rows).where("pos IS NOT NULL").groupBy("section", "field", "kind").agg(F.count("*").alias("n"))
    fields = encode.rel_fields(rows).select("section", "field").join(edges, "section")
    there = cells.groupBy("section", "field").agg(F.sum("n").alias("there"))
    absent = fields.join(there, ["section", "field"], "left").select("section", "field", F.lit("absent").alias("kind"), (F.col("edges") - F.coalesce("there", F.lit(0))).alias("n")).where("n > 0")
    return cells.unionByName(absent)


@query("o25_dictionary", """
WITH s AS (SELECT 'role:' || role AS s FROM conversations UNION SELECT role FROM conversations UNION SELECT k || turn FROM conversations, (VALUES ('turn:'), ('message:'), ('g:')) v(k)
  UNION SELECT 'i:' || turn FROM (SELECT turn, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations) WHERE b IS NOT NULL
  UNION SELECT text FROM conversations UNION SELECT unnest(['turn', 'message', 'prov:type', 'prov:value']))
SELECT s, dense_rank() OVER (ORDER BY s) - 1 AS sid FROM s""")
def dictionary(spark, sf_dir):
    return model.dictionary(_rows(spark, sf_dir, "dialogue", [shred.TALLY]), LEXICAL).select("s", "sid")


@query("o26_string_occurrences", """
WITH c AS (SELECT count(*) AS n FROM conversations), r AS (SELECT count(DISTINCT (conv_id, role)) AS n FROM conversations), d AS (SELECT count(DISTINCT conv_id) AS n FROM conversations)
SELECT 'node_id' AS role, 2 * c.n + r.n AS n FROM c, r UNION ALL SELECT 'edge_id', 2 * c.n - d.n FROM c, d UNION ALL SELECT 'cell', 2 * (2 * c.n - d.n) FROM c, d
UNION ALL SELECT 'key', 3 * c.n + r.n FROM c, r UNION ALL SELECT 'value', 3 * c.n + r.n FROM c, r""")
def occurrences(spark, sf_dir):
    return model.string_occurrences(_rows(spark, sf_dir, "dialogue", ["string"])).groupBy("role").agg(F.count("*").alias("n"))


_TEMPLATES = """SELECT '{"ex:brand":"' || p_brand || '","ex:type":"' || p_type || '","prov:type":"part"}' AS template, count(DISTINCT (l_orderkey, l_partkey)) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1
UNION ALL SELECT '{"ex:priority":"' || o_orderpriority || '","ex:status":"' || o_orderstatus || '","prov:type":"order"}', count(*) FROM orders GROUP BY 1
UNION ALL SELECT '{"prov:type":"fulfil"}', count(*) FROM orders
UNION ALL SELECT '{"ex:segment":"' || c_mktsegment || '","prov:type":"customer"}', count(*) FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1
UNION ALL SELECT '{"prov:type":"supplier"}', count(DISTINCT (l_orderkey, l_suppkey)) FROM lineitem"""


@query("o30_templates", _TEMPLATES)
def templates(spark, sf_dir):
    return _nodes(spark, sf_dir).groupBy("template").agg(F.count("*").alias("n"))


@query("o27_dense_ids", f"SELECT template, row_number() OVER (ORDER BY n DESC, template) - 1 AS tid FROM ({_TEMPLATES})")
def dense(spark, sf_dir):
    return model.templates(_nodes(spark, sf_dir), ProvConfig(id_order="frequency")).select("template", "tid")


_NODES = """
SELECT DISTINCT 'order/' || l_orderkey || '.json' AS graph, 'entity' AS section, 'part:' || l_partkey AS node, '{"ex:brand":"' || p_brand || '","ex:type":"' || p_type || '","prov:type":"part"}' AS template, 1 AS own FROM lineitem JOIN part ON l_partkey = p_partkey
UNION ALL SELECT 'order/' || o_orderkey || '.json', 'entity', 'order:' || o_orderkey, '{"ex:priority":"' || o_orderpriority || '","ex:status":"' || o_orderstatus || '","prov:type":"order"}', 2 FROM orders
UNION ALL SELECT 'order/' || o_orderkey || '.json', 'activity', 'fulfil:' || o_orderkey, '{"prov:type":"fulfil"}', 1 FROM orders
UNION ALL SELECT 'order/' || o_orderkey || '.json', 'agent', 'cust:' || o_custkey, '{"ex:segment":"' || c_mktsegment || '","prov:type":"customer"}', 0 FROM orders JOIN customer ON o_custkey = c_custkey
UNION ALL SELECT DISTINCT 'order/' || l_orderkey || '.json', 'agent', 'supp:' || l_suppkey, '{"prov:type":"supplier"}', 0 FROM lineitem"""


@query("o31_node_facts", f"SELECT graph, section, node, template, CAST(dense_rank() OVER (ORDER BY template) - 1 AS BIGINT) AS tid, CAST(own AS BIGINT) AS own FROM ({_NODES})")
def node_facts(spark, sf_dir):
    nodes = stable(_nodes(spark, sf_dir).drop("residual", "n_template", "n_residual"))
    strings = model.dictionary(_rows(spark, sf_dir, want=[shred.TALLY]), LEXICAL)
    dims = stable(model.templates(nodes, LEXICAL))
    facts = encode.node_facts(nodes, strings, dims).drop("item").join(strings.select("sid", F.col("s").alias("node")), "sid")
    return facts.join(dims.select("tid", "template"), "tid").select("graph", "section", "node", "template", "tid", F.size("own").cast("long").alias("own"))


@query("o32_edge_columns", f"""
SELECT 'order/' || l_orderkey || '.json' AS graph, 'u:' || rn AS edge, 'fulfil:' || l_orderkey AS activity, 'part:' || l_partkey AS entity, l_returnflag AS role,
       '{{"$":"' || strftime(l_shipdate, '%Y-%m-%dT%H:%M:%S') || '","type":"xsd:dateTime"}}' AS time, CAST(0 AS BIGINT) AS extras FROM {_LINES}""")
def edge_columns(spark, sf_dir):
    used = encode.edge_table(_rows(spark, sf_dir, want=ITEMS, sections=["used"]), "used")
    cell = lambda f, c: F.col(f"`prov:{f}`")[c].alias(f)
    return used.select("graph", F.col("item").alias("edge"), cell("activity", "text"), cell("entity", "text"), cell("role", "text"), cell("time", "json"), F.coalesce(F.size("extras"), F.lit(0)).cast("long").alias("extras"))


_EDGES = f"""
SELECT 'order/' || l_orderkey || '.json' AS graph, 'used' AS section, 'u:' || rn AS edge, unnest(['prov:activity', 'prov:entity', 'prov:role', 'prov:time']) AS field,
  unnest(['fulfil:' || l_orderkey, 'part:' || l_partkey, l_returnflag, '{{"$":"' || strftime(l_shipdate, '%Y-%m-%dT%H:%M:%S') || '","type":"xsd:dateTime"}}']) AS value FROM {_LINES}
UNION ALL SELECT DISTINCT 'order/' || l_orderkey || '.json', 'wasAttributedTo', 't:' || l_partkey || ':' || l_suppkey, unnest(['prov:entity', 'prov:agent']), unnest(['part:' || l_partkey, 'supp:' || l_suppkey]) FROM lineitem
UNION ALL SELECT 'order/' || o_orderkey || '.json', 'wasGeneratedBy', 'g', unnest(['prov:entity', 'prov:activity']), unnest(['order:' || o_orderkey, 'fulfil:' || o_orderkey]) FROM orders
UNION ALL SELECT 'order/' || o_orderkey || '.json', 'wasAssociatedWith', 'a', unnest(['prov:activity', 'prov:agent']), unnest(['fulfil:' || o_orderkey, 'cust:' || o_custkey]) FROM orders"""


@query("o32_all_relations", _EDGES)
def all_relations(spark, sf_dir):
    """Every relation's table, turned back into rows of one field each."""
    rows, out = _rows(spark, sf_dir, want=ITEMS, sections=DEFAULT.rel_schema), None
    for relation in ("used", "wasAttributedTo", "wasGeneratedBy", "wasAssociatedWith"):
        names = DEFAULT.rel_schema[relation]
        cells = F.array(*[F.struct(F.lit(f).alias("field"), F.coalesce(F.col(f"`{f}`.text"), F.col(f"`{f}`.json")).alias("value")) for f in names])
        own = encode.edge_table(rows, relation).select("graph", "section", F.col("item").alias("edge"), F.inline(F.filter(cells, lambda x: x["value"].isNotNull())))
        out = own if out is None else out.unionByName(own)
    return out


@query("o33_edge_count", """
SELECT 'order/' || o_orderkey || '.json' AS graph, coalesce(u, 0) + coalesce(t, 0) + 2 AS orig_edges FROM orders
LEFT JOIN (SELECT l_orderkey, count(*) AS u, count(DISTINCT (l_partkey, l_suppkey)) AS t FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""")
def edge_count(spark, sf_dir):
    return stats.edge_counts(_rows(spark, sf_dir, want=["section"], sections=DEFAULT.rel_schema))


@query("o34_node_count", """
SELECT 'order/' || o_orderkey || '.json' AS graph, coalesce(p, 0) + coalesce(s, 0) + 3 AS nodes, coalesce(p, 0) + 2 AS residual_nodes FROM orders
LEFT JOIN (SELECT l_orderkey, count(DISTINCT l_partkey) AS p, count(DISTINCT l_suppkey) AS s FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""")
def node_count(spark, sf_dir):
    return _nodes(spark, sf_dir).groupBy("graph").agg(F.count("*").alias("nodes"), F.count("residual").alias("residual_nodes"))


_STATS = """SELECT 'order/' || o_orderkey || '.json' AS graph, coalesce(p, 0) + coalesce(s, 0) + 3 AS orig_nodes, coalesce(u, 0) + coalesce(t, 0) + 2 AS orig_edges,
  coalesce(k, 0) + CASE WHEN s > 0 THEN 1 ELSE 0 END + 3 AS comp_nodes, coalesce(p, 0) + 2 AS residual_nodes FROM orders
LEFT JOIN (SELECT l_orderkey, count(*) AS u, count(DISTINCT (l_partkey, l_suppkey)) AS t, count(DISTINCT l_partkey) AS p, count(DISTINCT l_suppkey) AS s, count(DISTINCT (p_brand, p_type)) AS k
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1) ON l_orderkey = o_orderkey"""


@query("o35_graph_stats", f"SELECT *, orig_edges AS comp_edges, comp_nodes / orig_nodes AS nodes_ratio, CAST(1 AS DOUBLE) AS edges_ratio FROM ({_STATS})")
def graph_stats(spark, sf_dir):
    return stats.graph_stats(_rows(spark, sf_dir, want=FACTS))


_COMMERCE_STRINGS = f"""
SELECT DISTINCT s FROM (
  SELECT node AS s FROM ({_NODES}) UNION ALL SELECT edge FROM ({_EDGES}) UNION ALL SELECT value FROM ({_EDGES}) WHERE field != 'prov:time'
  UNION ALL SELECT unnest([strftime(l_shipdate, '%Y-%m-%dT%H:%M:%S'), p_brand, p_type, p_name]) FROM lineitem JOIN part ON l_partkey = p_partkey
  UNION ALL SELECT unnest([o_orderstatus, o_orderpriority, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S'), c_mktsegment]) FROM orders JOIN customer ON o_custkey = c_custkey
  UNION ALL SELECT unnest(['part', 'order', 'fulfil', 'customer', 'supplier', 'prov:type', 'ex:brand', 'ex:type', 'prov:label', 'ex:status', 'ex:priority', 'prov:value', '$', 'type', 'xsd:double', 'xsd:dateTime', 'prov:generatedAtTime', 'prov:startTime', 'ex:segment']))"""


@query("o36_corpus_totals", f"""
SELECT *, total_supernodes / orig_nodes AS node_dedup_ratio, true AS lossless, CAST(0 AS BIGINT) AS roundtrip_failures FROM (
  SELECT count(*) AS graphs, CAST(sum(orig_nodes) AS BIGINT) AS orig_nodes, CAST(sum(orig_edges) AS BIGINT) AS orig_edges, CAST(sum(residual_nodes) AS BIGINT) AS residual_nodes,
    (SELECT count(*) FROM ({_TEMPLATES})) AS total_supernodes, (SELECT count(*) FROM ({_COMMERCE_STRINGS})) AS dict_strings FROM ({_STATS}))""")
def corpus_totals(spark, sf_dir):
    docs = stored.corpus(spark, sf_dir, "commerce")
    rows = stable(shred.shred(docs, want=codec.FACTS))
    nodes = stable(model.node_records(rows))
    verified = stats.verify(docs, codec.compress(docs).decompress())
    return stats.corpus_totals(stats.graph_stats(rows, nodes), nodes, model.dictionary(rows), verified)


@query("o37_pooled", f"""
WITH c AS (SELECT 'part ' || (CAST(regexp_extract(graph, '[0-9]+') AS BIGINT) % 4) AS corpus, count(*) AS graphs, CAST(sum(orig_nodes) AS BIGINT) AS orig_nodes, CAST(sum(orig_edges) AS BIGINT) AS orig_edges,
    CAST(sum(100 * orig_nodes) AS BIGINT) AS input_bytes, CAST(sum(30 * comp_nodes) AS BIGINT) AS payload_bytes, max(orig_edges) AS peak_mb, bool_and(orig_edges < 15) AS lossless FROM ({_STATS}) GROUP BY 1)
SELECT *, (1 - payload_bytes / input_bytes) * 100 AS reduction FROM (
  SELECT coalesce(corpus, 'pooled') AS corpus, CAST(sum(graphs) AS BIGINT) AS graphs, CAST(sum(orig_nodes) AS BIGINT) AS orig_nodes, CAST(sum(orig_edges) AS BIGINT) AS orig_edges,
    CAST(sum(input_bytes) AS BIGINT) AS input_bytes, CAST(sum(payload_bytes) AS BIGINT) AS payload_bytes, max(peak_mb) AS peak_mb, bool_and(lossless) AS lossless FROM c GROUP BY ROLLUP (corpus))""")
def pooled(spark, sf_dir):
    per = stats.graph_stats(_rows(spark, sf_dir, want=FACTS)).withColumn("corpus", F.concat(F.lit("part "), (F.regexp_extract("graph", "[0-9]+", 0).cast("long") % 4).cast("string")))
    results = per.groupBy("corpus").agg(
        F.count("*").alias("graphs"), F.sum("orig_nodes").alias("orig_nodes"), F.sum("orig_edges").alias("orig_edges"), F.sum(100 * F.col("orig_nodes")).alias("input_bytes"),
        F.sum(30 * F.col("comp_nodes")).alias("payload_bytes"), F.max("orig_edges").alias("peak_mb"), F.every(F.col("orig_edges") < 15).alias("lossless"))
    return stats.pooled(results).select("corpus", "graphs", "orig_nodes", "orig_edges", "input_bytes", "payload_bytes", "peak_mb", "lossless", "reduction")


@query("o38_verify_summary", "SELECT count(*) FILTER (event_id % 7 != 0) AS checked, count(*) FILTER (event_id % 7 <= 1) AS failures, false AS lossless FROM events")
def verify_summary(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").cast("string").alias("graph"), F.col("props").alias("body"), (F.col("event_id") % 7).alias("m"))
    rebuilt = e.where("m != 0").select("graph", F.when(F.col("m") == 1, F.lit("{}")).otherwise(prov_canonical("body")).alias("text"))
    return stats.verify_summary(stats.verify(e, rebuilt))


@query("o39_encode_join", """
SELECT section, field, s, count(*) AS uses FROM (
  SELECT 'wasGeneratedBy' AS section, unnest(['prov:entity', 'prov:activity']) AS field, unnest(['message:' || turn, 'turn:' || turn]) AS s FROM conversations
  UNION ALL SELECT 'wasInformedBy', unnest(['prov:informed', 'prov:informant']), unnest(['turn:' || turn, 'turn:' || b]) FROM (SELECT turn, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations) WHERE b IS NOT NULL)
GROUP BY ALL""")
def encode_join(spark, sf_dir):
    rows = stable(_rows(spark, sf_dir, "dialogue"))
    strings = stable(model.dictionary(rows))
    return encode.edge_facts(rows, strings).groupBy("section", "field", "sid").agg(F.count("*").alias("uses")).join(strings, "sid").select("section", "field", "s", "uses")


@query("o41_template_overlay", """
SELECT 'conv/' || conv_id || '.json' AS graph, 'message:' || turn AS node, '{"prov:type":"message","prov:value":' || CAST(to_json(text) AS VARCHAR) || '}' AS record FROM conversations
UNION ALL SELECT 'conv/' || conv_id || '.json', 'turn:' || turn, '{"prov:type":"turn"}' FROM conversations
UNION ALL SELECT DISTINCT 'conv/' || conv_id || '.json', 'role:' || role, '{"prov:type":"' || role || '"}' FROM conversations""")
def template_overlay(spark, sf_dir):
    t = codec.compress(stored.corpus(spark, sf_dir, "dialogue")).tables
    return decode.node_texts(t["node"], t["dict"], t["template"]).select("graph", F.col("item").alias("node"), "record")


def _verified(corpus):
    def run(spark, sf_dir):
        docs = stored.corpus(spark, sf_dir, corpus)
        return stats.verify(docs, codec.compress(docs).decompress())

    return run


QUERIES["o42_verify_commerce"] = _verified("commerce")
ORACLE["o42_verify_commerce"] = "SELECT 'order/' || o_orderkey || '.json' AS graph, 'ok' AS state FROM orders"
QUERIES["o42_verify_dialogue"] = _verified("dialogue")
ORACLE["o42_verify_dialogue"] = "SELECT DISTINCT 'conv/' || conv_id || '.json' AS graph, 'ok' AS state FROM conversations"
QUERIES["o42_verify_telemetry"] = _verified("telemetry")
ORACLE["o42_verify_telemetry"] = "SELECT DISTINCT 'user/' || user_id || '.json' AS graph, 'ok' AS state FROM events"


@query("o43_canonical", """SELECT event_id, '{"k":' || CAST(json_extract(props, '$.k') AS VARCHAR) || '}' AS text FROM events""")
def canonical(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", prov_canonical("props").alias("text"))


@query("o45_bundles", "SELECT 'user/' || user_id || '.json' AS graph, 'kinds:' || event_type AS bundle, 'kind:' || event_type AS node FROM events GROUP BY ALL")
def bundles(spark, sf_dir):
    nodes = _nodes(spark, sf_dir, "telemetry")
    return nodes.where(F.size("path") == 1).select("graph", F.col("path")[0].alias("bundle"), F.col("item").alias("node"))


@query("o46_decompress", f"SELECT graph, section, node AS member, CAST(NULL AS VARCHAR) AS field, CAST(NULL AS VARCHAR) AS value FROM ({_NODES}) UNION ALL SELECT * FROM ({_EDGES})")
def decompress(spark, sf_dir):
    texts = codec.compress(stored.corpus(spark, sf_dir, "commerce")).decompress()
    sections = texts.select("graph", F.explode(F.from_json("text", "map<string,map<string,map<string,string>>>")).alias("section", "members"))
    rows = sections.select("graph", "section", F.explode("members").alias("member", "record"))
    nodes = rows.where(F.col("section").isin(*DEFAULT.node_sections)).select("graph", "section", "member", F.lit(None).cast("string").alias("field"), F.lit(None).cast("string").alias("value"))
    return nodes.unionByName(rows.where(~F.col("section").isin(*DEFAULT.node_sections)).select("graph", "section", "member", F.explode("record").alias("field", "value")))


@query("o47_package", "SELECT 'user/' || user_id || '.json' AS graph, true AS same FROM events GROUP BY user_id")
def package(spark, sf_dir):
    docs = stored.corpus(spark, sf_dir, "telemetry")
    return docs.select("graph", (views.prov_unpack(views.prov_pack("body")) == prov_canonical("body")).alias("same"))


@query("o48_corpus_views", "SELECT 'conv/' || conv_id || '.json' AS graph, true AS same FROM conversations GROUP BY conv_id")
def corpus_views(spark, sf_dir):
    docs = stored.corpus(spark, sf_dir, "dialogue")
    rows = stable(shred.shred(docs))
    strings, dims = stable(model.dictionary(rows)), stable(model.templates(model.node_records(rows)))
    written = views.corpus_views(docs, rows, strings, dims)
    known = views.Stored(strings, views.coded_templates(dims, strings), dict(DEFAULT.rel_schema), {})
    return stats.verify(docs, views.read_views(written, known)).select("graph", (F.col("state") == "ok").alias("same"))


@query("o53_incremental", """
WITH a AS (SELECT * FROM conversations WHERE conv_id % 2 = 0), b AS (SELECT * FROM conversations WHERE conv_id % 2 = 1),
x AS (SELECT text AS s FROM a UNION SELECT 'turn:' || turn FROM a), y AS (SELECT text AS s FROM b UNION SELECT 'turn:' || turn FROM b)
SELECT s, CASE WHEN s IN (SELECT s FROM x) THEN 'old' ELSE 'new' END AS batch FROM (SELECT s FROM x UNION SELECT s FROM y)""")
def incremental(spark, sf_dir):
    docs = stored.corpus(spark, sf_dir, "dialogue").withColumn("odd", F.regexp_extract("graph", "[0-9]+", 0).cast("long") % 2)
    first = codec.compress(docs.where("odd = 0").drop("odd"))
    old = first.tables["dict"]
    second = codec.compress(docs.where("odd = 1").drop("odd"), known=first).tables["dict"]
    top = old.agg(F.max("sid").alias("top"))
    texts = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.explode(F.array("text", F.concat(F.lit("turn:"), F.col("turn").cast("string")))).alias("s")).distinct()
    rows = second.join(texts, "s").withColumn("one", F.lit(1)).join(top.withColumn("one", F.lit(1)), "one")
    return rows.select("s", F.when(F.col("sid") <= F.col("top"), "old").otherwise("new").alias("batch"))


# Relations with their fields in order, and the keys that vary from record to record.
_RELATIONS = """
used: prov:activity prov:entity prov:role prov:time
wasGeneratedBy: prov:entity prov:activity prov:role prov:time
wasAssociatedWith: prov:activity prov:agent prov:plan prov:role
wasInformedBy: prov:informed prov:informant
wasAttributedTo: prov:entity prov:agent prov:role
wasDerivedFrom: prov:generatedEntity prov:usedEntity prov:activity prov:generation prov:usage
actedOnBehalfOf: prov:delegate prov:responsible prov:activity
wasStartedBy: prov:activity prov:trigger prov:starter prov:time
wasEndedBy: prov:activity prov:trigger prov:ender prov:time
wasInvalidatedBy: prov:entity prov:activity prov:role prov:time
wasInfluencedBy: prov:influencee prov:influencer
specializationOf: prov:specificEntity prov:generalEntity
alternateOf: prov:alternate1 prov:alternate2
hadMember: prov:collection prov:entity
mentionOf: prov:specificEntity prov:generalEntity prov:bundle
volatile: checksum:sha256 flowparams:sha256 model:path model:size_bytes openml:task_id pred:folds pred:rows pred:size_bytes prov:atTime prov:endTime prov:generatedAtTime prov:label prov:location prov:startTime prov:value split:size_bytes
"""
# End of fixed values.


@query("o59_constants", f"""
WITH lines AS (SELECT split_part(l, ': ', 1) AS section, string_split(split_part(l, ': ', 2), ' ') AS fields FROM (SELECT unnest(string_split(trim('{_RELATIONS}', chr(10)), chr(10))) AS l))
SELECT section, unnest(fields) AS field, CAST(unnest(range(len(fields))) AS INTEGER) AS pos FROM lines""")
def constants(spark, sf_dir):
    volatile = [("volatile", k, i) for i, k in enumerate(sorted(VOLATILE_ATTR_KEYS))]
    return encode.rel_fields(spark.range(0)).unionByName(spark.createDataFrame(volatile, "section string, field string, pos int"))


@query("o60_reduction", "SELECT o_orderkey, CASE WHEN o_totalprice > 0 THEN (1 - (o_orderkey % 100) / o_totalprice) * 100 ELSE 0.0 END AS reduction FROM orders")
def reduction(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return o.select("o_orderkey", stats.reduction_pct(F.col("o_orderkey") % 100, F.col("o_totalprice")).alias("reduction"))


@query("o63_minified", """SELECT event_id, CAST(strlen('{"k":' || CAST(json_extract(props, '$.k') AS VARCHAR) || '}') AS BIGINT) AS n FROM events""")
def minified(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", prov_minified_len("props").alias("n"))


@query("o24_display_label", "SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'GLM-4.6' WHEN 1 THEN 'Light' ELSE 'odd' || page_id END AS label FROM pages")
def display_label(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    mode = F.when(F.col("page_id") % 3 == 0, "z-ai_glm-4.6").when(F.col("page_id") % 3 == 1, "prov_corpus_light").otherwise(F.concat(F.lit("odd"), F.col("page_id").cast("string")))
    return p.select("page_id", stats.display_label(mode).alias("label"))


@query("ext_lineage", """
SELECT DISTINCT 'order:' || l_orderkey AS source, 'part:' || l_partkey AS reached, 2 AS hops FROM lineitem
UNION ALL SELECT DISTINCT 'order:' || l_orderkey, 'supp:' || s, min(3) FROM (SELECT l_orderkey, l_suppkey AS s FROM lineitem) GROUP BY ALL
UNION ALL SELECT 'order:' || o_orderkey, 'fulfil:' || o_orderkey, 1 FROM orders UNION ALL SELECT 'order:' || o_orderkey, 'cust:' || o_custkey, 2 FROM orders""")
def reach(spark, sf_dir):
    rows = _rows(spark, sf_dir, want=ITEMS, sections=DEFAULT.rel_schema)
    return lineage.reachable(lineage.edges(rows, distinct=False), F.col("source").startswith("order:")).select("source", "reached", "hops")


from . import queries_files  # noqa: E402, F401  registers its queries
