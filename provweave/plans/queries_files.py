"""Queries for sources, sinks, codec objects, harness and commands, with the SQL that checks them."""

from __future__ import annotations

import contextlib
import io
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.jsontext import minified
from ..operators import stats, views
from ..sources import files
from ..sources.provjson import ProvJsonSource, count_documents, read_corpus
from . import codec, harness, stored, workspace
from .registry import query

# --- what the tables say -----------------------------------------------------------------

_NAMES = "CASE page_id % 6 WHEN 0 THEN 'task.json' WHEN 1 THEN '_x.json' WHEN 2 THEN 'manifest.json' WHEN 3 THEN 'my_corpus_manifest.json' WHEN 4 THEN '.hidden.json' ELSE 'run.transcript.json' END"
_FOUND = f"SELECT 'p' || page_id || '/' || {_NAMES} AS graph, '{{\"url\":\"' || url || '\"}}' AS body FROM pages WHERE page_id % 6 IN (0, 1, 3)"
_STRINGS = """SELECT 'role:' || role AS s FROM conversations UNION SELECT role FROM conversations UNION SELECT k || turn FROM conversations, (VALUES ('turn:'), ('message:'), ('g:')) v(k)
  UNION SELECT 'i:' || turn FROM (SELECT turn, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations) WHERE b IS NOT NULL
  UNION SELECT text FROM conversations UNION SELECT unnest(['turn', 'message', 'prov:type', 'prov:value'])"""
_DOCS = """SELECT conv_id, 'conv/' || conv_id || '.json' AS graph, count(*) AS turns, count(DISTINCT role) AS roles FROM conversations GROUP BY conv_id"""
_COUNTS = f"SELECT graph, 2 * turns + roles AS orig_nodes, 2 * turns - 1 AS orig_edges, 2 + roles AS comp_nodes, turns AS residual_nodes FROM ({_DOCS})"
_TOTALS = f"""SELECT count(*) AS graphs, CAST(sum(orig_nodes) AS BIGINT) AS orig_nodes, CAST(sum(orig_edges) AS BIGINT) AS orig_edges, CAST(sum(residual_nodes) AS BIGINT) AS residual_nodes,
  2 + (SELECT count(DISTINCT role) FROM conversations) AS total_supernodes, (SELECT count(*) FROM ({_STRINGS})) AS dict_strings FROM ({_COUNTS})"""
_TOTAL_NAMES = ("graphs", "orig_nodes", "orig_edges", "residual_nodes", "total_supernodes", "dict_strings")


def _one(spark: SparkSession, schema: str, *rows: tuple) -> DataFrame:
    return spark.createDataFrame(list(rows), schema)


def _totals(spark: SparkSession, found: dict) -> DataFrame:
    return _one(spark, ", ".join(f"{n} long" for n in _TOTAL_NAMES), tuple(int(found[n]) for n in _TOTAL_NAMES))


# --- sources -------------------------------------------------------------------------------


@query("o01_discovery", f"SELECT graph, body, CAST(strlen(body) AS BIGINT) AS n_bytes, CAST(NULL AS VARCHAR) AS read_error FROM ({_FOUND})")
def discovery(spark, sf_dir):
    return read_corpus(spark, stored.pages_tree(spark, sf_dir))


@query("o03_second_discovery", f"SELECT graph, body FROM ({_FOUND})")
def second_discovery(spark, sf_dir):
    spark.dataSource.register(ProvJsonSource)
    return spark.read.format("provjson").load(stored.pages_tree(spark, sf_dir)).select("graph", "body")


@query("o04_count_documents", f"SELECT count(*) AS documents FROM ({_FOUND})")
def count(spark, sf_dir):
    return _one(spark, "documents long", (count_documents(spark, stored.pages_tree(spark, sf_dir)),))


@query("o06_load_model", f"SELECT s, 'string' AS kind FROM ({_STRINGS}) UNION ALL SELECT '{{\"prov:type\":\"' || t || '\"}}', 'template' FROM (SELECT DISTINCT role AS t FROM conversations UNION SELECT unnest(['turn', 'message']))")
def load_model(spark, sf_dir):
    found = codec.load_model(spark, stored.artifact(spark, sf_dir))
    templates = views.decoded_templates(found).select(F.col("template").alias("s"), F.lit("template").alias("kind"))
    return found.strings.select("s", F.lit("string").alias("kind")).unionByName(templates)


@query("o07_read_views", f"SELECT graph FROM ({_DOCS})")
def read_view_files(spark, sf_dir):
    return read_corpus(spark, f"{stored.artifact(spark, sf_dir)}/{codec.VIEW_DIR}").where("read_error IS NULL").select("graph")


# --- sinks ------------------------------------------------------------------------------------


def _views(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_corpus(spark, f"{stored.artifact(spark, sf_dir)}/{codec.VIEW_DIR}").select("graph", F.col("body").alias("view"))


def _section(name: str, mark: str):
    return F.coalesce(F.size(F.from_json(F.get_json_object("view", f"$.{name}.{mark}[0]"), "array<int>")), F.lit(0)).cast("long").alias(name)


@query("o08_view_per_document", f"SELECT graph, turns AS entity, turns AS activity, roles AS agent, turns AS wasGeneratedBy, turns - 1 AS wasInformedBy FROM ({_DOCS})")
def view_files(spark, sf_dir):
    sections = [_section(s, "_n") for s in ("entity", "activity", "agent")] + [_section(s, "_e") for s in ("wasGeneratedBy", "wasInformedBy")]
    return _views(spark, sf_dir).select("graph", *[F.when(c.isNull() | (c < 0), 0).otherwise(c).cast("long").alias(n) for c, n in zip(sections, ("entity", "activity", "agent", "wasGeneratedBy", "wasInformedBy"))])


@query("o09_model_file", _TOTALS)
def model_file(spark, sf_dir):
    return _totals(spark, codec.model_members(spark, stored.artifact(spark, sf_dir))["meta"])


@query("o10_stats_csv", f"SELECT graph, orig_nodes, orig_edges, comp_nodes, orig_edges AS comp_edges, round(comp_nodes / orig_nodes, 4) AS nodes_ratio, CAST(1 AS DOUBLE) AS edges_ratio FROM ({_COUNTS})")
def stats_csv(spark, sf_dir):
    schema = "graph string, orig_nodes long, orig_edges long, comp_nodes long, comp_edges long, nodes_ratio double, edges_ratio double"
    return spark.read.schema(schema).csv(f"{stored.artifact(spark, sf_dir)}/{codec.STATS_FILE}", header=True, escape='"')


@query("o11_verification_log", f"SELECT graph, 'compressed_graphs/' || graph AS path, true AS canonical_ok FROM ({_DOCS})")
def verification_log(spark, sf_dir):
    return spark.read.schema("graph string, path string, canonical_ok boolean").json(f"{stored.artifact(spark, sf_dir)}/{codec.LOG_FILE}")


@query("o12_reconstructed", "SELECT 'conv/' || conv_id || '.json' AS graph, 'message:' || turn AS node, text AS value FROM conversations")
def reconstructed(spark, sf_dir):
    entity = F.from_json(F.get_json_object("body", "$.entity"), "map<string,struct<`prov:value`:string>>")
    return read_corpus(spark, stored.rebuilt(spark, sf_dir)).select("graph", F.explode(entity).alias("node", "r")).select("graph", "node", F.col("r.prov:value").alias("value"))


@query("o13_replace", f"SELECT true AS refused, true AS refused_inside, count(*) AS views FROM ({_DOCS})")
def replace(spark, sf_dir):
    source = stored.tree(spark, sf_dir)
    with workspace.folder(spark) as out:
        files.put_text(spark, f"{out}/{codec.VIEW_DIR}/old.json", "{}")
        said = []
        for target in (out, f"{source}/inside"):
            try:
                codec.compress_directory(spark, source, target)
            except (FileExistsError, ValueError):
                said.append(True)
        codec.compress_directory(spark, source, out, overwrite=True)
        return _one(spark, "refused boolean, refused_inside boolean, views long", (*said, count_documents(spark, f"{out}/{codec.VIEW_DIR}")))


def _results(spark: SparkSession, sf_dir: str) -> list[harness.Result]:
    """Measures made up from the tables: one corpus per order status, with some bytes of each order."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.sum("o_custkey").alias("big"), F.max("o_orderkey").alias("t"))
    zero = dict.fromkeys(("minified_bytes", "orig_nodes", "orig_edges", "total_supernodes", "dict_strings", "residual_nodes", "roundtrip_failures"), 0)
    return [harness.Result(corpus=r["o_orderstatus"], graphs=r["n"], input_bytes=r["big"], payload_bytes=r["n"], compress_s=float(r["t"]), decompress_s=1.0, peak_mb=float(r["n"]), lossless=True, **zero) for r in o.collect()]


_MEASURES = "SELECT o_orderstatus AS corpus, count(*) AS graphs, CAST(sum(o_custkey) AS BIGINT) AS input_bytes, count(*) AS payload_bytes, max(o_orderkey) AS t FROM orders GROUP BY 1"


@query("o14_results_json", f"SELECT corpus, graphs, input_bytes, payload_bytes, round((1 - payload_bytes / input_bytes) * 100, 6) AS reduction, CAST(NULL AS VARCHAR) AS failed, true AS complete FROM ({_MEASURES})")
def results_json(spark, sf_dir):
    with workspace.folder(spark) as out:
        whole = json.loads(files.get_text(spark, harness.save_json(spark, _results(spark, sf_dir), out, [])))
    rows = [(r["corpus"], r["graphs"], r["input_bytes"], r["payload_bytes"], round(r["reduction"], 6), ",".join(whole["failed_corpora"]) or None, whole["complete"]) for r in whole["results"]]
    return _one(spark, "corpus string, graphs long, input_bytes long, payload_bytes long, reduction double, failed string, complete boolean", *rows)


@query("o15_latex", f"SELECT corpus, CAST(row_number() OVER (ORDER BY input_bytes) AS BIGINT) AS place, graphs, printf('%.3f', payload_bytes / 1e6) AS payload FROM ({_MEASURES})")
def latex(spark, sf_dir):
    with workspace.folder(spark) as out:
        text = files.get_text(spark, harness.save_latex(spark, _results(spark, sf_dir), out))
    cells = [line.removesuffix(" \\\\").split(" & ") for line in text.split("\\end{table}")[0].split("\n") if " & " in line][1:]
    return _one(spark, "corpus string, place long, graphs long, payload string", *[(c[0], i, int(c[1]), c[4]) for i, c in enumerate(cells, 1)])


@query("o16_scaling_fit", f"SELECT round(regr_slope(t, input_bytes), 9) AS slope, round(regr_intercept(t, input_bytes), 3) AS intercept, round(regr_r2(t, input_bytes), 9) AS r2 FROM ({_MEASURES})")
def scaling(spark, sf_dir):
    fit = stats.scaling_fit(harness.table(spark, _results(spark, sf_dir)))
    return fit.select(F.round("slope", 9).alias("slope"), F.round("intercept", 3).alias("intercept"), F.round("r2", 9).alias("r2"))


# --- views -------------------------------------------------------------------------------------


@query("o22_marker_detection", f"SELECT graph, unnest(['entity', 'activity', 'agent', 'wasGeneratedBy'] || CASE WHEN turns > 1 THEN ['wasInformedBy'] ELSE [] END) AS section, unnest(['_n', '_n', '_n', '_e'] || CASE WHEN turns > 1 THEN ['_e'] ELSE [] END) AS mark FROM ({_DOCS})")
def marker_detection(spark, sf_dir):
    sections = F.from_json("view", "map<string,string>")
    rows = _views(spark, sf_dir).select("graph", F.explode(sections).alias("section", "value"))
    keys = F.json_object_keys("value")
    return rows.where(F.size(keys) == 1).select("graph", "section", keys[0].alias("mark"))


@query("o23_empty_residual", f"SELECT graph, turns AS activity, roles AS agent, CAST(0 AS BIGINT) AS entity FROM ({_DOCS})")
def empty_residual(spark, sf_dir):
    zeros = lambda s: F.size(F.filter(F.from_json(F.get_json_object("view", f"$.{s}._n[2]"), "array<string>"), lambda x: x == "0")).cast("long").alias(s)
    return _views(spark, sf_dir).select("graph", zeros("activity"), zeros("agent"), zeros("entity"))


def _mapped(rows: DataFrame, column: str, f) -> DataFrame:
    """``rows`` with a JSON text column replaced by ``f`` of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(column)
            yield batch.set_column(at, column, pa.array([f(x) for x in batch.column(column).to_pylist()], pa.string()))

    return rows.mapInArrow(run, rows.schema)


@query("o28_generic_encode", """SELECT event_id, '{"#0":[{"$":1},' || CAST(json_extract(props, '$.k') AS VARCHAR) || ',{"#1":{"$":0}}]}' AS coded FROM events""")
def generic_encode(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    value = F.concat(F.lit('{"k":["'), "event_type", F.lit('",'), F.get_json_object("props", "$.k"), F.lit(',{"'), "event_type", F.lit('":"k"}]}'))
    return _mapped(e.select("event_id", value.alias("coded")), "coded", lambda x: minified(views.encode_value(json.loads(x), views.Model().sid)))


@query("o29_generic_decode", """SELECT event_id, '{"k":["' || event_type || '",' || CAST(json_extract(props, '$.k') AS VARCHAR) || ',{"' || event_type || '":"k"}]}' AS value FROM events""")
def generic_decode(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    coded = F.concat(F.lit('[["k","'), "event_type", F.lit('"],{"#0":[{"$":1},'), F.get_json_object("props", "$.k"), F.lit(',{"#1":{"$":0}}]}]'))

    def decoded(text: str) -> str:
        strings, value = json.loads(text)
        return minified(views.decode_value(value, strings))

    return _mapped(e.select("event_id", coded.alias("value")), "value", decoded)


@query("o40_decode_lookup", """
SELECT 'conv/' || conv_id || '.json' AS graph, 'g:' || turn AS edge, f AS field, CASE f WHEN 'prov:entity' THEN 'message:' ELSE 'turn:' END || turn AS s FROM conversations, (VALUES ('prov:entity'), ('prov:activity')) v(f)
UNION ALL SELECT 'conv/' || conv_id || '.json', 'i:' || turn, f, 'turn:' || CASE f WHEN 'prov:informed' THEN turn ELSE b END
  FROM (SELECT *, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations), (VALUES ('prov:informed'), ('prov:informant')) v(f) WHERE b IS NOT NULL""")
def decode_lookup(spark, sf_dir):
    t = codec.compress(stored.corpus(spark, sf_dir, "dialogue")).tables
    return t["edge_field"].where("sid IS NOT NULL").join(t["dict"].select("sid", "s"), "sid").select("graph", F.col("item").alias("edge"), "field", "s")


_OWN = """SELECT 'conv/' || conv_id || '.json' AS graph, count(DISTINCT s) + 4 AS strings, 2 + count(DISTINCT role) AS templates FROM (
  SELECT conv_id, role, unnest(['role:' || role, role, 'turn:' || turn, 'message:' || turn, 'g:' || turn, text, CASE WHEN b IS NOT NULL THEN 'i:' || turn END]) AS s
  FROM (SELECT *, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations)) GROUP BY conv_id"""


@query("o44_compress_document", f"SELECT * FROM ({_OWN})")
def compress_document(spark, sf_dir):
    packed = stored.corpus(spark, sf_dir, "dialogue").select("graph", views.prov_pack("body").alias("p"))
    return packed.select("graph", F.json_array_length(F.get_json_object("p", "$.model.dict")).cast("long").alias("strings"), F.json_array_length(F.get_json_object("p", "$.model.templates")).cast("long").alias("templates"))


# --- corpora ---------------------------------------------------------------------------------


@query("o49_corpus_decompress", f"SELECT count(*) AS files, count(*) AS same FROM ({_DOCS})")
def corpus_decompress(spark, sf_dir):
    source = stored.artifact(spark, sf_dir)
    with workspace.folder(spark) as out:
        n = codec.decompress_directory(spark, source, out)
        same = harness.compare(read_corpus(spark, stored.tree(spark, sf_dir)), read_corpus(spark, out)).where("state = 'ok'").count()
    return _one(spark, "files long, same long", (n, same))


@query("o50_corpus_verify", f"SELECT count(*) AS checked, CAST(1 AS BIGINT) AS failures, false AS lossless, 'more.json' AS mismatches FROM ({_DOCS})")
def corpus_verify(spark, sf_dir):
    with workspace.folder(spark) as originals:
        codec._write_each(stored.corpus(spark, sf_dir, "dialogue"), originals, "body", indent=False)
        files.put_text(spark, f"{originals}/more.json", "{}")  # has no reconstruction
        found = codec.verify_directory(spark, originals, stored.artifact(spark, sf_dir))
    return _one(spark, "checked long, failures long, lossless boolean, mismatches string", (found["checked"], found["failures"], found["lossless"], ",".join(found["mismatches"])))


@query("o51_in_run_verify", f"SELECT count(*) AS graphs, true AS lossless, CAST(0 AS BIGINT) AS roundtrip_failures FROM ({_DOCS})")
def in_run_verify(spark, sf_dir):
    with workspace.folder(spark) as out:
        found = codec.compress_directory(spark, stored.tree(spark, sf_dir), out, verify=True)
    return _one(spark, "graphs long, lossless boolean, roundtrip_failures long", (found["graphs"], found["lossless"], found["roundtrip_failures"]))


def _by_codec(docs: DataFrame, run, schema: str) -> DataFrame:
    """``run(documents)`` of each partition's documents (graph, value), with codec objects of its own."""

    def all_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(g, json.loads(b)) for batch in batches for g, b in zip(batch.column("graph").to_pylist(), batch.column("body").to_pylist())]
        yield pa.RecordBatch.from_pylist(run(rows), pa.schema(out))

    kinds = {"string": pa.string(), "boolean": pa.bool_(), "bigint": pa.int64()}
    empty = docs.sparkSession.createDataFrame([], schema)
    out = [(n, kinds[k]) for n, k in empty.dtypes]
    return docs.select("graph", "body").mapInArrow(all_, empty.schema)


@query("o52_codec_class", f"SELECT graph, true AS same, true AS known_again FROM ({_DOCS})")
def codec_class(spark, sf_dir):
    def run(rows):
        own = codec.ProvCodec()
        first = [own.compress(v) for _, v in rows]
        size = len(own.dump_model()["dict"])
        again = [own.compress(v) for _, v in rows]
        return [{"graph": g, "same": codec.equal(own.decompress(w), v), "known_again": w == x and size == len(own.dump_model()["dict"])} for (g, v), w, x in zip(rows, again, first)]

    return _by_codec(stored.corpus(spark, sf_dir, "dialogue"), run, "graph string, same boolean, known_again boolean")


@query("o54_codec_decompress", "SELECT 'conv/' || conv_id || '.json' AS graph, 'turn:' || turn AS node FROM conversations")
def codec_decompress(spark, sf_dir):
    def run(rows):
        own = codec.ProvCodec()
        coded = [(g, json.loads(json.dumps(own.compress(v)))) for g, v in rows]
        return [{"graph": g, "node": n} for g, w in coded for n in own.decompress(w)["activity"]]

    return _by_codec(stored.corpus(spark, sf_dir, "dialogue"), run, "graph string, node string")


@query("o55_dump_model", f"SELECT s FROM ({_STRINGS})")
def dump_model(spark, sf_dir):
    def run(rows):
        own = codec.ProvCodec()
        for _, v in rows:
            own.compress(v)
        return [{"s": s} for s in json.loads(own.dump_model_json())["dict"]]

    return _by_codec(stored.corpus(spark, sf_dir, "dialogue"), run, "s string").distinct()


@query("o56_restore_model", f"SELECT graph, true AS same, true AS ids_kept FROM ({_DOCS})")
def restore_model(spark, sf_dir):
    def run(rows):
        own, half = codec.ProvCodec(), len(rows) // 2
        early = [own.compress(v) for _, v in rows[:half]]
        dumped = own.dump_model_json()
        restored = codec.ProvCodec.from_model_json(dumped)
        coded = early + [restored.compress(v) for _, v in rows[half:]]  # a restored model goes on
        before, after = json.loads(dumped)["dict"], restored.dump_model()["dict"]
        return [{"graph": g, "same": codec.equal(restored.decompress(w), v), "ids_kept": after[: len(before)] == before} for (g, v), w in zip(rows, coded)]

    return _by_codec(stored.corpus(spark, sf_dir, "dialogue"), run, "graph string, same boolean, ids_kept boolean")


@query("o57_codec_compress_directory", _TOTALS)
def codec_compress_directory(spark, sf_dir):
    own = codec.ProvCodec()
    own.compress({"entity": {"never in the corpus": {}}})  # the directory gets a model of its own
    with workspace.folder(spark) as out:
        return _totals(spark, own.compress_directory(spark, stored.tree(spark, sf_dir), out))


@query("o58_directory_functions", f"SELECT count(*) AS compressed, count(*) AS decompressed, count(*) AS verified FROM ({_DOCS})")
def directory_functions(spark, sf_dir):
    import provweave

    source = stored.tree(spark, sf_dir)
    with workspace.folder(spark) as top:
        made = provweave.compress_directory(spark, source, f"{top}/out")
        n = provweave.decompress_directory(spark, f"{top}/out", f"{top}/back")
        checked = provweave.verify_directory(spark, source, f"{top}/out")
    return _one(spark, "compressed long, decompressed long, verified long", (made["graphs"], n, checked["checked"] - checked["failures"]))


# --- harness and commands ------------------------------------------------------------------------


@query("o61_directory_bytes", f"SELECT CAST(sum(strlen('{{\"url\":\"' || url || '\"}}')) AS BIGINT) AS bytes FROM pages")
def directory_bytes(spark, sf_dir):
    return _one(spark, "bytes long", (harness.folder_bytes(spark, stored.pages_tree(spark, sf_dir)),))


@query("o62_payload_bytes", f"SELECT CAST(2 + sum(strlen(body)) AS BIGINT) AS bytes FROM ({_FOUND})")
def payload(spark, sf_dir):
    found = read_corpus(spark, stored.pages_tree(spark, sf_dir)).select(F.concat(F.lit(f"{codec.VIEW_DIR}/"), "graph").alias("graph"), "body")
    with workspace.folder(spark) as out:
        codec._write_each(found, out, "body", indent=False)
        for name in (codec.MODEL_FILE, codec.STATS_FILE, codec.LOG_FILE):
            files.put_text(spark, f"{out}/{name}", "{}")
        return _one(spark, "bytes long", (harness.payload_bytes(spark, out),))


_BENCHED: dict[tuple[str, str], harness.Result] = {}


def _benched(spark: SparkSession, sf_dir: str) -> harness.Result:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _BENCHED:
        _BENCHED[key] = harness.measure(spark, stored.tree(spark, sf_dir), "dialogue")
    return _BENCHED[key]


@query("o64_timed_run", "SELECT 'dialogue' AS corpus, true AS timed, true AS traced")
def timed_run(spark, sf_dir):
    r = _benched(spark, sf_dir)
    return _one(spark, "corpus string, timed boolean, traced boolean", (r.corpus, r.compress_s > 0 and r.decompress_s > 0, r.peak_mb > 1))


@query("o65_directory_compare", f"SELECT graph, CASE WHEN conv_id % 3 = 0 THEN 'differs' WHEN conv_id % 3 = 1 THEN 'missing' ELSE 'ok' END AS state FROM ({_DOCS})")
def directory_compare(spark, sf_dir):
    back = read_corpus(spark, stored.rebuilt(spark, sf_dir)).withColumn("m", F.regexp_extract("graph", "[0-9]+", 0).cast("long") % 3)
    changed = back.where("m != 1").select("graph", F.when(F.col("m") == 0, F.lit("{}")).otherwise(F.col("body")).alias("body"))
    return harness.compare(read_corpus(spark, stored.tree(spark, sf_dir)), changed)


@query("o66_full_benchmark", f"SELECT *, true AS lossless, CAST(0 AS BIGINT) AS roundtrip_failures FROM ({_TOTALS})")
def full_benchmark(spark, sf_dir):
    r = _benched(spark, sf_dir)
    return _totals(spark, vars(r)).select("*", F.lit(r.lossless).alias("lossless"), F.lit(r.roundtrip_failures).cast("long").alias("roundtrip_failures"))


@query("o67_result_record", f"SELECT corpus, graphs, input_bytes, payload_bytes, false AS is_pooled FROM ({_MEASURES}) UNION ALL SELECT 'all', CAST(sum(graphs) AS BIGINT), CAST(sum(input_bytes) AS BIGINT), CAST(sum(payload_bytes) AS BIGINT), true FROM ({_MEASURES})")
def result_record(spark, sf_dir):
    results = _results(spark, sf_dir)
    return harness.table(spark, [*results, harness.pool(results, "all")]).select("corpus", "graphs", "input_bytes", "payload_bytes", "is_pooled")


@query("o68_result_order", f"SELECT corpus, CAST(row_number() OVER (ORDER BY input_bytes) AS BIGINT) AS place FROM ({_MEASURES})")
def result_order(spark, sf_dir):
    names = [r["corpus"] for r in harness.table(spark, _results(spark, sf_dir)).collect()]
    return _one(spark, "corpus string, place long", *[(n, i) for i, n in enumerate(names, 1)])


def _command(spark: SparkSession, *args: str) -> tuple[int, str]:
    """Exit code and output of a command."""
    from .. import cli

    with contextlib.redirect_stdout(io.StringIO()) as said:
        code = cli.main(list(args), spark)
    return code, said.getvalue()


@query("o69_benchmark_command", f"SELECT CAST(0 AS BIGINT) AS code, CAST(1 AS BIGINT) AS code_of_a_failure, 'dialogue,telemetry,all' AS corpora, true AS complete, (SELECT count(*) FROM ({_DOCS})) + (SELECT count(DISTINCT user_id) FROM events) AS pooled_graphs")
def benchmark_command(spark, sf_dir):
    with workspace.folder(spark) as top:
        sources = [x for name in ("dialogue", "telemetry") for x in ("--corpus", f"{name}={stored.tree(spark, sf_dir, name)}")]
        code, _ = _command(spark, "bench", *sources, "--output", f"{top}/r", "--pooled-name", "all", "--skip-figures")
        whole = json.loads(files.get_text(spark, f"{top}/r/benchmark_results.json"))
        files.put_text(spark, f"{top}/bad/a.json", "{")
        failed, _ = _command(spark, "bench", "--corpus", f"{top}/bad", "--output", f"{top}/f", "--skip-figures")
    rows = {r["corpus"]: r for r in whole["results"]}
    return _one(spark, "code long, code_of_a_failure long, corpora string, complete boolean, pooled_graphs long", (code, failed, ",".join(rows), whole["complete"], rows["all"]["graphs"]))


@query("o70_compress_command", f"SELECT CAST(0 AS BIGINT) AS code, * FROM ({_TOTALS})")
def compress_command(spark, sf_dir):
    with workspace.folder(spark) as out:
        code, said = _command(spark, "compress", "--input", stored.tree(spark, sf_dir), "--out", out, "--verify")
    return _totals(spark, json.loads(said)).select(F.lit(code).cast("long").alias("code"), "*")


@query("o71_decompress_command", f"SELECT CAST(0 AS BIGINT) AS code, count(*) AS reconstructed_files FROM ({_DOCS})")
def decompress_command(spark, sf_dir):
    with workspace.folder(spark) as out:
        code, said = _command(spark, "decompress", "--input", stored.artifact(spark, sf_dir), "--out", out)
    return _one(spark, "code long, reconstructed_files long", (code, json.loads(said)["reconstructed_files"]))


@query("o72_verify_command", f"SELECT CAST(0 AS BIGINT) AS code, CAST(1 AS BIGINT) AS code_if_lossy, count(*) AS checked, CAST(1 AS BIGINT) AS failures FROM ({_DOCS})")
def verify_command(spark, sf_dir):
    artifact = stored.artifact(spark, sf_dir)
    code, said = _command(spark, "verify", "--orig", stored.tree(spark, sf_dir), "--compressed", artifact)
    with workspace.folder(spark) as lossy:
        files.put_text(spark, f"{lossy}/conv/0.json", '{"other":1}')
        bad, found = _command(spark, "verify", "--orig", lossy, "--compressed", artifact)
    return _one(spark, "code long, code_if_lossy long, checked long, failures long", (code, bad, json.loads(said)["checked"], json.loads(found)["failures"]))


@query("o73_arguments", "SELECT * FROM (VALUES ('bench'), ('compress'), ('decompress'), ('verify'), ('')) v(command), (SELECT CAST(2 AS BIGINT) AS code_without_arguments)")
def arguments(spark, sf_dir):
    from .. import cli

    rows = []
    for command in ("bench", "compress", "decompress", "verify", ""):
        try:
            with contextlib.redirect_stderr(io.StringIO()):
                cli.parser().parse_args([command] if command else [])
        except SystemExit as e:
            rows.append((command, e.code))
    return _one(spark, "command string, code_without_arguments long", *rows)


@query("ext_sql_functions", "SELECT 'conv/' || conv_id || '.json' AS graph, true AS same, 2 * count(*) + count(DISTINCT role) AS nodes FROM conversations GROUP BY conv_id")
def sql_functions(spark, sf_dir):
    from . import sql

    sql.register(spark)
    stored.corpus(spark, sf_dir, "dialogue").createOrReplaceTempView("prov_documents")
    return spark.sql("""
        WITH nodes AS (SELECT d.graph, count(*) AS nodes FROM prov_documents d, LATERAL prov_shred(d.graph, d.body) r WHERE r.what = 'item' AND r.route = 'node' GROUP BY d.graph)
        SELECT graph, prov_unpack(prov_pack(body)) = prov_canonical(body) AS same, nodes FROM prov_documents JOIN nodes USING (graph)""")


