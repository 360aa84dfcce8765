"""Corpora: compress, decompress and verify directories, natively or for interchange.

The native form is a directory of Parquet tables that stay queryable: ``dict``, ``template``, ``node``,
``edge``, ``edge_field``, ``section``, ``doc``, ``bundle`` and ``meta``.  The interchange form is one JSON model file and one JSON view per document.
"""

from __future__ import annotations

import functools
import io
import itertools
import json
import math
import os
import time
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..config import DEFAULT, ProvConfig
from ..functions.jsontext import canonical, members, pretty, quoted
from ..operators import decode, encode, model, shred, stats, views
from ..operators.stable import passing, stable, stores
from ..sources import files
from ..sources.provjson import count_documents, read_corpus

TABLES = ("dict", "template", "node", "edge", "edge_field", "section", "doc", "bundle")

#: Nodes and edges that are decoded at once where results are stored; shares at most, as each is joined with the whole dictionary.
ITEMS_AT_ONCE, MOST_SHARES = 2_000_000, 4

#: What compression needs of the shredder; with whole items, what counts need as well.
CODED = ("doc", "section", shred.SPLIT, "error", shred.TALLY)
FACTS = ("doc", "section", "item", "error", shred.TALLY)

# Fixed values of the interchange form: names of files, keys of the model file's meta, columns
# of the statistics, keys of the log.
MODEL_FILE, VIEW_DIR, STATS_FILE, LOG_FILE = "compressed_corpus.json", "compressed_graphs", "benchmarks.csv", "decompressed_sanity.jsonl"
META_TOTALS = ("graphs", "dict_strings", "total_supernodes", "orig_nodes", "orig_edges", "residual_nodes")
META_MORE = ("created_at", "compress_ms", "lossless_definition", "markers")
LOSSLESS = "canonical-JSON (sort_keys) exact round-trip"
STATS_COLUMNS = ("graph", "orig_nodes", "orig_edges", "comp_nodes", "comp_edges", "nodes_ratio", "edges_ratio")
LOG_KEYS = ("graph", "path", "canonical_ok")
# End of fixed values.


@dataclass
class Compressed:
    """A compressed corpus as tables."""

    tables: dict[str, DataFrame]
    config: ProvConfig
    depth: int
    #: Whether ``node`` and ``edge_field`` are joins that have not been run.
    derived: bool = False
    #: Nodes, edges and bundles; None where they have not been counted.
    items: int | None = None

    def write(self, path: str, mode: str = "error") -> None:
        """Parquet tables below ``path``; node and edge tables are partitioned by section."""
        for name, table in self.tables.items():
            writer = table.write.mode(mode)
            (writer.partitionBy("section") if name in ("node", "edge", "edge_field") else writer).parquet(f"{path}/{name}")
        spark = self.tables["dict"].sparkSession
        meta = Row(depth=self.depth, id_order=self.config.id_order, rel_schema=json.dumps(self.config.rel_schema), volatile=json.dumps(sorted(self.config.volatile_keys)), node_sections=json.dumps(self.config.node_sections), schemas=json.dumps({t: d.schema.jsonValue() for t, d in self.tables.items()}))
        spark.createDataFrame([meta]).write.mode(mode).parquet(f"{path}/meta")

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> Compressed:
        meta = spark.read.parquet(f"{path}/meta").first()
        config = ProvConfig(node_sections=tuple(json.loads(meta["node_sections"])), rel_schema={k: tuple(v) for k, v in json.loads(meta["rel_schema"]).items()}, volatile_keys=frozenset(json.loads(meta["volatile"])), id_order=meta["id_order"])
        schemas = {t: StructType.fromJson(s) for t, s in json.loads(meta["schemas"]).items()}  # an empty table has no file to infer from
        return cls({t: spark.read.schema(schemas[t]).parquet(f"{path}/{t}") for t in TABLES}, config, meta["depth"])

    def decompress(self) -> DataFrame:
        """(graph, text): canonical text of every document, from these tables alone.

        Large corpora are decoded by shares of their documents where results are stored: a share's exchanges are gone before the next.
        """
        n = self._shares()
        if n == 1:
            return self._decoded(self.tables)
        done = []
        for i in range(n):
            own = {k: t.where(F.pmod(F.xxhash64("graph"), F.lit(n)) == i) if "graph" in t.columns else t for k, t in self.tables.items()}
            with passing() as lasting:
                done.append(lasting(self._decoded(own)))
        return functools.reduce(DataFrame.unionByName, done)

    def _shares(self) -> int:
        if not stores(self.tables["dict"].sparkSession):
            return 1
        items = self.items if self.items is not None else sum(self.tables[t].count() for t in ("node", "edge"))
        return max(1, min(MOST_SHARES, math.ceil(items / ITEMS_AT_ONCE)))

    def _decoded(self, t: dict[str, DataFrame]) -> DataFrame:
        with passing() as lasting:  # facts go when texts are there, and each step's shuffle files with the step
            facts = {n: stable(t[n]) if self.derived else t[n] for n in ("node", "edge_field")}
            nodes = decode.node_texts(facts["node"], t["dict"], t["template"])
            fields = decode.edge_texts(facts["edge_field"], t["dict"])
            nodes, fields = lasting(nodes), lasting(fields)
        return decode.assemble(t["doc"], t["section"], nodes, t["edge"], fields, t["bundle"], self.depth)

    def views(self, prefix: str = "prov_") -> None:
        """Temporary views over the tables, for SQL."""
        for name, table in self.tables.items():
            table.createOrReplaceTempView(prefix + name)


def compress(corpus: DataFrame, config: ProvConfig = DEFAULT, known: Compressed | None = None) -> Compressed:
    """Compress a corpus (graph, body); with ``known`` its model is used and grows by what is new."""
    if known is not None:
        config = known.config
    rows = stable(shred.shred(corpus, config, CODED))
    nodes = model.split_nodes(rows)
    if known is None:
        strings, templates = model.dictionary(rows, config), model.templates(nodes, config)
    else:
        old_s, old_t = known.tables["dict"], known.tables["template"]
        strings = old_s.unionByName(model.dictionary(rows, config, old_s))
        templates = old_t.unionByName(model.templates(nodes, config, old_t))
    strings, templates = stable(strings), stable(templates)
    item = rows.where("what = 'item'").select(*encode.ITEM, "section_json", "item_json", "item_ord", "route")
    tables = {
        "dict": strings, "template": templates, "node": encode.node_facts(nodes, strings, templates),
        "edge": item.where("route = 'edge'").drop("route"), "edge_field": encode.edge_facts(rows, strings, config),
        "section": rows.where("what = 'section'").select(*encode.DOC, "section", "section_json", "route", "json"),
        "doc": rows.where("what = 'doc'").select(*encode.DOC, "kind", "json"),
        "bundle": item.where("route = 'bundle'").select(*encode.ITEM, "item_json"),
    }
    depth, items = rows.agg(F.coalesce(F.max(F.size("path")), F.lit(0)), F.count_if(F.col("what") == "item")).first()
    return Compressed(tables, config, max(0, depth), derived=True, items=items)


# --- directories ---------------------------------------------------------------------


def _apart(source: str, target: str) -> None:
    """Refuse to write into, over or around the input."""
    whole = lambda p: os.path.realpath(files.plain(p)) if files.is_local(p) else p.rstrip("/")
    a, b = whole(source), whole(target)
    if f"{a}/".startswith(f"{b}/") or f"{b}/".startswith(f"{a}/"):
        raise ValueError(f"{target} and {source} must not contain each other")


def _fresh(spark: SparkSession, path: str, overwrite: bool) -> None:
    if files.exists(spark, path):
        if not overwrite:
            raise FileExistsError(path)
        files.delete(spark, path)


def _write_each(texts: DataFrame, folder: str, column: str, indent: bool) -> None:
    """One file per row, named by graph, from the executors."""

    def write(rows: Iterator[Row]) -> None:
        for row in rows:
            text = pretty(json.loads(row[column])) if indent else row[column]
            with files.opened(f"{folder}/{row['graph']}", "wb") as f:
                f.write(text.encode())

    texts.foreachPartition(write)


def write_model(strings: DataFrame, templates: DataFrame, config: ProvConfig, meta: dict, path: str) -> None:
    """The model file: one JSON object, its lists written by Spark in parts that are then put end to end."""
    spark, rest = strings.sparkSession, {"rel_schema": {k: list(v) for k, v in config.rel_schema.items()}, "meta": meta} | views.own_config(config)

    def quote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([quoted(s) for s in batch.column("s").to_pylist()], pa.string())], ["value"])

    strings.orderBy("sid").select("s").mapInArrow(quote, "value string").write.option("lineSep", ",").text(f"{path}.dict")
    views.coded_templates(templates, strings).orderBy("tid").select("coded").write.option("lineSep", ",").text(f"{path}.templates")
    more = json.dumps(rest, separators=(",", ":"), ensure_ascii=False)
    files.joined(spark, path, ['{"dict":[', (f"{path}.dict", 1), '],"templates":[', (f"{path}.templates", 1), f"],{more[1:]}"])


def write_stats(per_graph: DataFrame, path: str) -> None:
    """The statistics file, sorted by graph: written by Spark in parts that are then put end to end."""
    spark = per_graph.sparkSession
    rows = per_graph.withColumn("nodes_ratio", F.round("nodes_ratio", 4)).select(*STATS_COLUMNS)
    rows.orderBy("graph").write.option("emptyValue", "").option("escape", '"').csv(f"{path}.parts")
    files.one_file(spark, f"{path}.parts", path, ",".join(STATS_COLUMNS))


def write_log(checked: DataFrame, path: str) -> None:
    """The verification log, one JSON object a document, sorted by graph."""
    values = {"graph": F.col("graph"), "path": F.concat(F.lit(f"{VIEW_DIR}/"), "graph"), "canonical_ok": F.col("state") == "ok"}
    checked.orderBy("graph").select(F.to_json(F.struct(*[values[k].alias(k) for k in LOG_KEYS]))).write.text(f"{path}.parts")
    files.one_file(checked.sparkSession, f"{path}.parts", path)


@passing()
def compress_directory(spark: SparkSession, source: str, out: str, verify: bool = False, overwrite: bool = False, config: ProvConfig = DEFAULT) -> dict:
    """Compress a tree of documents to the interchange form; totals as a dict.

    The model is new, whatever a codec object may have learnt before.
    """
    _apart(source, out)
    _fresh(spark, out, overwrite)
    began = time.time()
    corpus = stable(read_corpus(spark, source))
    readable = corpus.where("read_error IS NULL")
    rows = stable(shred.shred(readable, config))
    nodes = stable(model.node_records(rows, config))
    strings, templates = stable(model.dictionary(rows, config)), stable(model.templates(nodes, config))
    _write_each(views.corpus_views(readable, rows, strings, templates, config, nodes), f"{out}/{VIEW_DIR}", "view", indent=False)
    per_graph = stable(stats.graph_stats(rows, nodes, config))
    totals = stats.corpus_totals(per_graph, nodes, strings).first().asDict()
    more = (time.time(), int((time.time() - began) * 1000), LOSSLESS, {"node": views.NODES, "edge": views.EDGES, "string": views.STRING})
    meta = {k: totals[k] for k in META_TOTALS} | dict(zip(META_MORE, more))
    write_model(strings, templates, config, meta, f"{out}/{MODEL_FILE}")
    write_stats(per_graph, f"{out}/{STATS_FILE}")
    if verify:
        good = readable.join(shred.errors(rows).select("graph"), "graph", "left_anti")
        checked = stable(stats.verify(good, read_compressed(spark, out)))
        write_log(checked, f"{out}/{LOG_FILE}")
        totals |= {k: v for k, v in stats.corpus_totals(per_graph, nodes, strings, checked).first().asDict().items() if k in ("lossless", "roundtrip_failures")}
    return totals | {"compress_s": time.time() - began}


def _model_rows(spark: SparkSession, folder: str) -> DataFrame:
    """(part, id, text): strings of an interchange directory's model file, its templates as JSON, and its other members.

    One task reads the file as a stream and holds some MB of it; where only Hadoop reads the store, a task gets it whole.
    """
    path = f"{folder}/{MODEL_FILE}"
    direct = files.is_local(path) or files.arrow_reads(path)
    rows = spark.createDataFrame([(path, None)], "path string, content binary").repartition(1) if direct else spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content").to_pylist():
                with files.opened(path, "rb") if direct else io.BytesIO(content) as f:
                    found = ((p, i, v if p == "dict" and i is not None else json.dumps(v, ensure_ascii=False)) for p, i, v in members(f, frozenset({"dict", "templates"})))
                    while some := list(itertools.islice(found, 10_000)):
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some), (pa.string(), pa.int64(), pa.string()))], ["part", "id", "text"])

    return rows.mapInArrow(run, "part string, id long, text string")


def model_members(spark: SparkSession, folder: str) -> dict:
    """What a model file holds besides its strings and templates."""
    return {r["part"]: json.loads(r["text"]) for r in _model_rows(spark, folder).where("id IS NULL").toLocalIterator()}


def load_model(spark: SparkSession, folder: str) -> views.Stored:
    """An interchange directory's model, as tables."""
    rows = stable(_model_rows(spark, folder))
    strings = rows.where("part = 'dict' AND id IS NOT NULL").select(F.col("id").alias("sid"), F.col("text").alias("s"))
    templates = rows.where("part = 'templates' AND id IS NOT NULL").select(F.col("id").alias("tid"), F.col("text").alias("coded"))
    rest = {r["part"]: json.loads(r["text"]) for r in rows.where("id IS NULL").toLocalIterator()}
    return views.Stored(strings, templates, rest.get("rel_schema", {k: list(v) for k, v in DEFAULT.rel_schema.items()}), rest.get("meta", {}))


def read_compressed(spark: SparkSession, folder: str) -> DataFrame:
    """(graph, text): documents of an interchange directory."""
    found = read_corpus(spark, f"{folder}/{VIEW_DIR}").select("graph", F.col("body").alias("view"))
    return views.read_views(found, load_model(spark, folder))


@passing()
def decompress_directory(spark: SparkSession, compressed: str, out: str, overwrite: bool = False) -> int:
    """Rebuild the tree of documents; returns how many."""
    _apart(compressed, out)
    _fresh(spark, out, overwrite)
    _write_each(read_compressed(spark, compressed), out, "text", indent=True)
    return count_documents(spark, out)


@passing()
def verify_directory(spark: SparkSession, originals: str, compressed: str) -> dict:
    """Compare an artifact with its originals: checked, failures, lossless, mismatches."""
    checked = stable(stats.verify(read_corpus(spark, originals), read_compressed(spark, compressed)))
    summary = stats.verify_summary(checked).first().asDict()
    return summary | {"mismatches": [r["graph"] for r in stats.mismatches(checked).collect()]}


class ProvCodec:
    """A growing model for single documents: compress, decompress, dump and restore."""

    def __init__(self, config: ProvConfig = DEFAULT):
        self.model = views.Model(config)

    def compress(self, doc: object) -> object:
        return self.model.compress(doc)

    def decompress(self, view: object) -> object:
        return self.model.decompress(view)

    def dump_model(self) -> dict:
        return self.model.dump()

    def dump_model_json(self, indent: int | None = None) -> str:
        return json.dumps(self.dump_model(), ensure_ascii=False, indent=indent)

    @classmethod
    def from_model(cls, dumped: dict) -> ProvCodec:
        codec = cls()
        codec.model = views.Model.load(dumped)
        return codec

    @classmethod
    def from_model_json(cls, text: str) -> ProvCodec:
        return cls.from_model(json.loads(text))

    @staticmethod
    def compress_directory(spark: SparkSession, source: str, out: str, **options) -> dict:
        return compress_directory(spark, source, out, **options)


compress_document, decompress_document = views.pack, views.unpack
equal = lambda a, b: canonical(a) == canonical(b)
