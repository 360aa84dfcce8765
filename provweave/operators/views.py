"""Interchange views: one JSON text per document beside a shared model.

The format: a string is ``{"$": id}``, a key ``#id``; a node section ``{"_n": [ids, templates,
residuals]}``, a relation ``{"_e": [ids, columns, extras]}``, bundles ``{"_b": [ids, views]}``; in
a relation's columns null is an absent field, a number a string, a list of one any other
value.  Here a document is taken apart by a writer that only asks a lookup for ids, so the
lookup may be a growing model (one document) or the ids that a join has brought along
(a corpus).
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import StringType, StructField, StructType

from ..config import DEFAULT, ProvConfig
from ..functions.jsontext import canonical, minified, parse
from .model import node_records, string_occurrences
from .shred import route

# Marks of the format.
NODES, EDGES, BUNDLES, STRING, KEY = "_n", "_e", "_b", "$", "#"
VERSION = "1.0.0"
# End of fixed values.


def encode_value(value: Any, sid: Callable[[str], int]) -> Any:
    match value:
        case str():
            return {STRING: sid(value)}
        case dict():
            return {f"{KEY}{sid(k)}": encode_value(v, sid) for k, v in value.items()}
        case list():
            return [encode_value(v, sid) for v in value]
    return value


def decode_value(value: Any, strings: Any) -> Any:
    match value:
        case {"$": int(i), **rest} if not rest:
            return strings[i]
        case dict():
            return {strings[int(k.removeprefix(KEY))]: decode_value(v, strings) for k, v in value.items()}
        case list():
            return [decode_value(v, strings) for v in value]
    return value


class Writer:
    """Documents to views; ``sid`` and ``tid`` give ids of strings and of template texts."""

    def __init__(self, sid: Callable[[str], int], tid: Callable[[dict], int], config: ProvConfig = DEFAULT):
        self.sid, self.tid, self.config = sid, tid, config

    def view(self, doc: Any) -> Any:
        if isinstance(doc, str):
            raise ValueError("a bare string is no document: wrap it in an object")
        if not isinstance(doc, dict):
            return encode_value(doc, self.sid)
        make = {"node": self._nodes, "edge": self._edges, "bundle": self._bundles, "other": lambda _, v: encode_value(v, self.sid)}
        return {name: make[route(name, section, self.config)](name, section) for name, section in doc.items()}

    def _rest(self, fields: dict) -> Any:
        return encode_value(fields, self.sid) if fields else 0

    def _nodes(self, _: str, section: dict) -> dict:
        rows = []
        for name, record in section.items():
            own = {k: v for k, v in record.items() if k in self.config.volatile_keys}
            shared = {k: v for k, v in record.items() if k not in own}
            rows.append((self.sid(name), self.tid(shared), self._rest(own)))
        return {NODES: [list(c) for c in zip(*rows)] if rows else [[], [], []]}

    def _cell(self, record: dict, name: str) -> Any:
        if name not in record:
            return None
        value = record[name]
        return self.sid(value) if isinstance(value, str) else [encode_value(value, self.sid)]

    def _edges(self, relation: str, section: dict) -> dict:
        names = self.config.rel_schema[relation]
        rows = [(self.sid(e), [self._cell(r, n) for n in names], self._rest({k: v for k, v in r.items() if k not in names})) for e, r in section.items()]
        return {EDGES: [[r[0] for r in rows], [[r[1][i] for r in rows] for i in range(len(names))], [r[2] for r in rows]]}

    def _bundles(self, _: str, section: dict) -> dict:
        rows = [(self.sid(name), self.view(member)) for name, member in section.items()]
        return {BUNDLES: [[r[0] for r in rows], [r[1] for r in rows]]}


class Reader:
    """Views to documents, from strings, decoded templates and the relation schema of a model."""

    def __init__(self, strings: Any, templates: Any, rel_schema: dict):
        self.strings, self.templates, self.rel_schema = strings, templates, rel_schema

    def document(self, view: Any) -> Any:
        return {k: self._section(k, v) for k, v in view.items()} if isinstance(view, dict) else decode_value(view, self.strings)

    def _rest(self, coded: Any) -> dict:
        return decode_value(coded, self.strings) if coded != 0 else {}

    def _section(self, name: str, view: Any) -> Any:
        match view:
            case {"_n": [ids, templates, own], **rest} if not rest:
                return {self.strings[i]: {**self.templates[t], **self._rest(r)} for i, t, r in zip(ids, templates, own)}
            case {"_e": [ids, columns, extras], **rest} if not rest:
                fields = self.rel_schema[name]
                out = {}
                for row, (i, extra) in enumerate(zip(ids, extras)):
                    cells = [(f, c[row]) for f, c in zip(fields, columns) if c[row] is not None]
                    out[self.strings[i]] = {f: decode_value(c[0], self.strings) if isinstance(c, list) else self.strings[c] for f, c in cells} | self._rest(extra)
                return out
            case {"_b": [ids, views], **rest} if not rest:
                return {self.strings[i]: self.document(v) for i, v in zip(ids, views)}
        return decode_value(view, self.strings)


def own_config(config: ProvConfig) -> dict:
    """What a dumped model must say of its configuration beyond the relation schema: what is not the default."""
    own = {"node_sections": list(config.node_sections)} if config.node_sections != DEFAULT.node_sections else {}
    return own | ({"volatile_keys": sorted(config.volatile_keys)} if config.volatile_keys != DEFAULT.volatile_keys else {})


class Model:
    """A small model in memory, for single documents; a corpus keeps its model in tables."""

    def __init__(self, config: ProvConfig = DEFAULT):
        self.config = config
        self.sids: dict[str, int] = {}
        self.tids: dict[str, int] = {}
        self.templates: list[dict] = []

    def sid(self, s: str) -> int:
        return self.sids.setdefault(s, len(self.sids))

    def tid(self, template: dict) -> int:
        key = canonical(template)
        if key not in self.tids:
            self.tids[key] = len(self.tids)
            self.templates.append(template)
            encode_value(template, self.sid)
        return self.tids[key]

    def compress(self, doc: Any) -> Any:
        return Writer(self.sid, self.tid, self.config).view(doc)

    def decompress(self, view: Any) -> Any:
        return Reader(list(self.sids), self.templates, self.config.rel_schema).document(view)

    def dump(self) -> dict:
        return {"version": VERSION, "dict": list(self.sids), "templates": [encode_value(t, self.sid) for t in self.templates], "rel_schema": {k: list(v) for k, v in self.config.rel_schema.items()}} | own_config(self.config)

    @classmethod
    def load(cls, dumped: dict) -> Model:
        """A dumped model; it goes on compressing with the configuration it was made with."""
        schema = {k: tuple(v) for k, v in dumped.get("rel_schema", DEFAULT.rel_schema).items()}
        model = cls(ProvConfig(tuple(dumped.get("node_sections", DEFAULT.node_sections)), schema, frozenset(dumped.get("volatile_keys", DEFAULT.volatile_keys))))
        model.sids = {s: i for i, s in enumerate(dumped["dict"])}
        model.templates = [decode_value(t, dumped["dict"]) for t in dumped["templates"]]
        model.tids = {canonical(t): i for i, t in enumerate(model.templates)}
        return model


def pack(doc: Any) -> dict:
    """A self-contained package of one document."""
    model = Model()
    view = model.compress(doc)
    return {"provweave": VERSION, "model": model.dump(), "view": view}


def unpack(package: dict) -> Any:
    return Model.load(package["model"]).decompress(package["view"])


@arrow_udf(StringType())
def prov_pack(texts: pa.Array) -> pa.Array:
    """Documents to packages; null for what is no document."""
    return pa.array([None if r else minified(pack(v)) for v, r in map(parse, texts.to_pylist())], pa.string())


@arrow_udf(StringType())
def prov_unpack(texts: pa.Array) -> pa.Array:
    """Packages to canonical documents."""
    return pa.array([None if x is None else canonical(unpack(json.loads(x))) for x in texts.to_pylist()], pa.string())


def corpus_views(corpus: DataFrame, shredded: DataFrame, dictionary: DataFrame, templates: DataFrame, config: ProvConfig = DEFAULT, nodes: DataFrame | None = None) -> DataFrame:
    """(graph, view): views of all good documents against the corpus's tables.

    A document gets only the ids it uses: its strings and templates joined with the
    dimensions and gathered per document.
    """
    sids = string_occurrences(shredded).select("graph", "s").distinct().join(dictionary.select("s", "sid"), "s")
    sids = sids.groupBy("graph").agg(F.map_from_entries(F.collect_list(F.struct("s", "sid"))).alias("sids"))
    nodes = node_records(shredded, config) if nodes is None else nodes
    tids = nodes.select("graph", "template").distinct().join(templates.select("template", "tid"), "template")
    tids = tids.groupBy("graph").agg(F.map_from_entries(F.collect_list(F.struct("template", "tid"))).alias("tids"))
    good = corpus.join(shredded.where("what = 'error'").select("graph"), "graph", "left_anti")
    rows = good.select("graph", "body").join(sids, "graph", "left").join(tids, "graph", "left").select("graph", "body", F.to_json("sids").alias("sids"), F.to_json("tids").alias("tids"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for body, s, t in zip(*(batch.column(c).to_pylist() for c in ("body", "sids", "tids"))):
                s, t = json.loads(s or "{}"), json.loads(t or "{}")
                out.append(minified(Writer(s.__getitem__, lambda x, t=t: t[canonical(x)], config).view(parse(body)[0])))
            yield pa.RecordBatch.from_arrays([batch.column("graph"), pa.array(out, pa.string())], ["graph", "view"])

    return rows.mapInArrow(write, StructType([StructField("graph", StringType()), StructField("view", StringType())]))


@dataclass
class Stored:
    """A corpus's model as tables: strings (sid, s), templates (tid, coded), and its small members."""

    strings: DataFrame
    templates: DataFrame
    rel_schema: dict
    meta: dict


class _Noted:
    """Stands for a model's list and notes what it is asked for."""

    def __init__(self, make: Callable[[int], Any]):
        self.make, self.ids = make, set()

    def __getitem__(self, i: int) -> Any:
        self.ids.add(i)
        return self.make(i)


IDS = "array<struct<id:bigint,text:string>>"


def _by_id(pairs: list[dict] | None, make: Callable[[str], Any] = str) -> dict[int, Any]:
    return {x["id"]: make(x["text"]) for x in pairs or []}


def _each(rows: DataFrame, key: str, column: str, schema: str, find: Callable[[Any], Iterator[tuple]]) -> DataFrame:
    """(key, ...): the rows that ``find`` makes of each JSON text in a column."""
    out = rows.sparkSession.createDataFrame([], schema).schema
    kinds = [pa.int64() if f.dataType.typeName() == "long" else pa.string() for f in out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(k, *x) for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for x in find(json.loads(text))]
            columns = list(zip(*found)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], out.names)

    return rows.select(key, column).mapInArrow(run, out)


def _gathered(used: DataFrame, key: str, table: DataFrame, ident: str, text: str, name: str) -> DataFrame:
    """(key, name): for each key the pairs of ids and texts that it uses, in no order."""
    rows = used.join(table.select(F.col(ident).alias("id"), F.col(text).alias("text")), "id")
    return rows.groupBy(key).agg(F.collect_list(F.struct("id", "text")).alias(name))


def coded_templates(templates: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(tid, coded): template texts (tid, template) with ids for strings."""

    def strings(value: Any) -> Iterator[tuple]:
        noted: dict[str, None] = {}
        encode_value(value, lambda s: noted.setdefault(s) or 0)
        return ((s,) for s in noted)

    used = _each(templates, "tid", "template", "tid long, s string", strings).join(dictionary.select("s", F.col("sid").alias("id")), "s")
    ids = used.groupBy("tid").agg(F.collect_list(F.struct("id", F.col("s").alias("text"))).alias("sids"))
    rows = templates.select("tid", "template").join(ids, "tid", "left").select("tid", "template", F.coalesce("sids", F.array().cast(IDS)).alias("sids"))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [minified(encode_value(json.loads(t), {x["text"]: x["id"] for x in p}.__getitem__)) for t, p in zip(batch.column("template").to_pylist(), batch.column("sids").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("tid"), pa.array(out, pa.string())], ["tid", "coded"])

    return rows.mapInArrow(code, "tid long, coded string")


def decoded_templates(model: Stored) -> DataFrame:
    """(tid, template): canonical texts of a stored model's templates."""

    def ids(value: Any) -> Iterator[tuple]:
        noted = _Noted(str)
        decode_value(value, noted)
        return ((i,) for i in noted.ids)

    used = _gathered(_each(model.templates, "tid", "coded", "tid long, id long", ids), "tid", model.strings, "sid", "s", "strings")
    rows = model.templates.join(used, "tid", "left").select("tid", "coded", "strings")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [canonical(decode_value(json.loads(t), _by_id(p))) for t, p in zip(batch.column("coded").to_pylist(), batch.column("strings").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("tid"), pa.array(out, pa.string())], ["tid", "template"])

    return rows.mapInArrow(read, "tid long, template string")


def read_views(views: DataFrame, model: Stored) -> DataFrame:
    """(graph, text): canonical documents of interchange views and their stored model.

    No process holds the model: a document gets the strings and templates that it uses, as in ``corpus_views``.
    """
    schema = model.rel_schema

    def ids(view: Any) -> Iterator[tuple]:
        strings, templates = _Noted(str), _Noted(lambda i: {})
        Reader(strings, templates, schema).document(view)
        yield from (("s", i) for i in strings.ids)
        yield from (("t", i) for i in templates.ids)

    used = _each(views, "graph", "view", "graph string, kind string, id long", ids).distinct()
    strings = _gathered(used.where("kind = 's'"), "graph", model.strings, "sid", "s", "strings")
    templates = _gathered(used.where("kind = 't'"), "graph", decoded_templates(model), "tid", "template", "templates")
    rows = views.select("graph", "view").join(strings, "graph", "left").join(templates, "graph", "left").select("graph", "view", "strings", "templates")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [canonical(Reader(_by_id(s), _by_id(t, json.loads), schema).document(json.loads(v))) for v, s, t in zip(*(batch.column(c).to_pylist() for c in ("view", "strings", "templates")))]
            yield pa.RecordBatch.from_arrays([batch.column("graph"), pa.array(out, pa.string())], ["graph", "text"])

    return rows.mapInArrow(read, StructType([StructField("graph", StringType()), StructField("text", StringType())]))
