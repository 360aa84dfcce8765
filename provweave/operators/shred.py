"""One parse per document: tagged rows from which everything else is relational.

A row is about a (bundle) document, a section, an item (node, edge or bundle member) with
its fields, or a string of the dictionary.  Empty sections and empty records have rows
of their own, so nothing is lost that has no field.  The fields of an item stay together, in order of
their names: what is about one item needs no exchange, and what is about fields unfolds them.
"""

from __future__ import annotations

import itertools
import operator
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.functions import udtf
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from ..config import DEFAULT, ProvConfig
from ..functions.jsontext import canonical, kind, parse, quoted

#: Of a field: its name, that as JSON, kind of its value, its text if it is a string, its canonical JSON.
FIELD = ("field", "field_json", "kind", "text", "json")

SCHEMA = StructType([
    StructField("graph", StringType()),
    StructField("path", ArrayType(StringType())),  # bundle names from the root down
    StructField("what", StringType()),  # doc, section, item, string or tally, error
    StructField("section", StringType()),
    StructField("section_json", StringType()),
    StructField("route", StringType()),  # node, edge, bundle, other
    StructField("item", StringType()),
    StructField("item_json", StringType()),
    StructField("item_ord", IntegerType()),  # of an item; members of a section; occurrences of a tally
    StructField("fields", ArrayType(StructType([StructField(c, StringType()) for c in FIELD]))),  # of an item, by name
    StructField("kind", StringType()),  # s i f b n o a
    StructField("text", StringType()),  # of a string
    StructField("json", StringType()),  # canonical
    StructField("role", StringType()),  # of a string: node_id, edge_id, bundle_id, cell, key, value
    StructField("seq", LongType()),
])


#: What a row can be about; ``want`` names those that a caller needs.
WHATS = ("doc", "section", "item", "string", "error")
#: Instead of strings: each distinct string of a batch once, with its occurrences and the first of them.
TALLY = "tally"
#: Instead of items, rows about them as a compressed corpus needs them: of a node its template (``text``) and its volatile
#: ``fields``; of an edge ``fields`` with the text of cells that the dictionary holds, and the JSON of all others.
SPLIT = "split"
#: Names of fields that a shredder keeps.
NAMES = 10_000
#: Rows of a batch that leaves the shredder.
BATCH = 20_000
_ARROW = {"path": pa.list_(pa.string()), "item_ord": pa.int32(), "seq": pa.int64()}
_NAMES = SCHEMA.names
_first = operator.itemgetter(0)


def route(name: str, section: object, config: ProvConfig) -> str:
    """Whole sections go one way: one member that is no object makes a section ``other``."""
    known = "node" if name in config.node_sections else "edge" if name in config.rel_schema else "bundle" if name == "bundle" else "other"
    return known if isinstance(section, dict) and all(isinstance(v, dict) for v in section.values()) else "other"


class _Shredder:
    """Rows of documents as columns; ``seq`` counts all rows of a document, wanted or not."""

    def __init__(self, config: ProvConfig, want: frozenset[str], sections: frozenset[str] | None):
        self.split = SPLIT in want
        self.config, self.want, self.sections = config, want | {"item"} if self.split else want, sections
        self.names: dict[str, str] = {}
        self.seq, self.rows, self.tallies = 0, [], {}
        self.tallied, self.texts = TALLY in want, TALLY in want or "string" in want

    def take(self) -> pa.RecordBatch:
        """The rows so far, as one batch."""
        self.rows += [(graph, (), TALLY, None, None, None, None, None, n, (), None, text, None, None, seq) for text, (n, graph, seq) in self.tallies.items()]
        columns = list(zip(*self.rows)) if self.rows else [()] * len(_NAMES)
        self.rows, self.tallies = [], {}
        at = _NAMES.index("fields")
        flat = list(zip(*itertools.chain.from_iterable(columns[at]))) or [()] * len(FIELD)
        ends = pa.array([0, *itertools.accumulate(map(len, columns[at]))], pa.int32())
        fields = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([pa.array(c, pa.string()) for c in flat], FIELD))
        return pa.RecordBatch.from_arrays([fields if i == at else pa.array(c, _ARROW.get(n, pa.string())) for i, (n, c) in enumerate(zip(_NAMES, columns))], _NAMES)

    def row(self, what: str, path: list[str], section: tuple = (None, None, None), item: tuple = (None, None, None), fields: Sequence[tuple] = (), kind: str | None = None, text: str | None = None, json: str | None = None, role: str | None = None) -> None:
        """``section``: name, JSON and route; ``item``: name, JSON and number; ``fields``: as FIELD."""
        self.seq += 1
        if what in self.want:
            self.rows.append((self.graph, path, what, *section, *item, fields, kind, text, json, role, self.seq))

    def say(self, path: list[str], role: str, text: str) -> None:
        """A string of the dictionary."""
        if self.tallied:
            self.seq += 1
            n, first = self.own.get(text, (0, self.seq))
            self.own[text] = (n + 1, first)
        else:
            self.row("string", path, text=text, role=role)

    def strings(self, path: list[str], value: object) -> None:
        """Keys and string leaves of any value, in order, without recursion."""
        todo = [value]
        while todo:
            now = todo.pop()
            if isinstance(now, tuple):
                self.say(path, "key", now[0])
                todo.append(now[1])
            elif isinstance(now, str):
                self.say(path, "value", now)
            elif isinstance(now, dict):
                todo.extend(reversed(now.items()))
            elif isinstance(now, list):
                todo.extend(reversed(now))

    def document(self, path: list[str], value: object) -> None:
        letter = kind(value)
        self.row("doc", path, kind=letter, json=None if letter == "o" else canonical(value))
        if letter != "o":
            if self.texts:
                self.strings(path, value)
            return
        for name, section in value.items():
            way = route(name, section, self.config)
            if self.sections is not None and name not in self.sections:
                for item, member in section.items() if way == "bundle" else ():
                    self.document([*path, item], member)
                continue
            at = (name, quoted(name), way)
            size = len(section) if isinstance(section, dict | list) else None
            self.row("section", path, at, (None, None, size), kind=kind(section), json=canonical(section) if way == "other" else None)
            if way == "other":
                if self.texts:
                    self.strings(path, section)
            else:
                for i, (item, content) in enumerate(section.items()):
                    self.item(path, at, (item, quoted(item), i), content)

    def item(self, path: list[str], section: tuple, item: tuple, content: dict) -> None:
        name, _, way = section
        fields, template = (), None
        if way != "bundle" and "item" in self.want:
            if self.split:
                fields, template = self.halves(name, way, content)
            else:
                fields = [(k, self.name(k), kind(v), v if type(v) is str else None, canonical(v)) for k, v in sorted(content.items(), key=_first)]
        self.row("item", path, section, item, fields, text=template)
        if self.texts:
            self.say(path, f"{way}_id", item[0])
        if way == "bundle":
            self.document([*path, item[0]], content)
        elif self.texts:
            columns = self.config.rel_schema.get(name, ()) if way == "edge" else ()
            for key, value in content.items():
                if key not in columns:
                    self.say(path, "key", key)
                if key in columns and type(value) is str:
                    self.say(path, "cell", value)
                else:
                    self.strings(path, value)

    def name(self, field: str) -> str:
        """A field's name as JSON; what recurs is kept."""
        found = self.names.get(field)
        if found is None:
            if len(self.names) >= NAMES:
                self.names.clear()
            found = self.names[field] = quoted(field)
        return found

    def halves(self, section: str, way: str, content: dict) -> tuple[list[tuple], str | None]:
        """Fields as SPLIT has them, and the template of a node."""
        pairs = sorted(content.items(), key=_first) if len(content) > 1 else content.items()
        if way == "node":
            volatile = self.config.volatile_keys
            own = [(k, self.name(k), None, None, canonical(v)) for k, v in pairs if k in volatile]
            return own, "{" + ",".join([f"{self.name(k)}:{canonical(v)}" for k, v in pairs if k not in volatile]) + "}"
        columns = self.config.rel_schema.get(section, ())
        return [(k, self.name(k), "s", v, None) if type(v) is str and k in columns else (k, self.name(k), kind(v), None, canonical(v)) for k, v in pairs], None

    def shred(self, graph: str, text: str | None) -> None:
        """Rows of one document; a single ``error`` row for a text that is none."""
        self.graph, self.seq, self.own, before = graph, 0, {}, len(self.rows)
        value, reason = parse(text)
        if reason is None:
            try:
                self.document([], value)
            except RecursionError:
                reason = "too_deep"
        if reason is not None:
            self.seq = 0
            del self.rows[before:]
            self.row("error", [], text=reason)
            return
        for text, (n, seq) in self.own.items():
            had = self.tallies.get(text)
            self.tallies[text] = (n, graph, seq) if had is None else (had[0] + n, *min(had[1:], (graph, seq)))


def shred(corpus: DataFrame, config: ProvConfig = DEFAULT, want: Iterable[str] = WHATS, sections: Iterable[str] | None = None) -> DataFrame:
    """SCHEMA rows of a corpus (graph, body).

    ``want``: only rows about these; strings are the larger half, and the dictionary alone needs
    them, for which their TALLY will do, as SPLIT items do for a compressed corpus.  ``sections``: only what stands in these sections, at any depth.
    """
    wanted, inside = frozenset(want), None if sections is None else frozenset(sections)
    if not wanted <= {*WHATS, TALLY, SPLIT} or {"string", TALLY} <= wanted or {"item", SPLIT} <= wanted:
        raise ValueError(f"want must be among {WHATS}, with {TALLY} for string and {SPLIT} for item at will")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shredder = _Shredder(config, wanted, inside)
        for batch in batches:
            for graph, body in zip(batch.column("graph").to_pylist(), batch.column("body").to_pylist()):
                shredder.shred(graph, body)
                if len(shredder.rows) + len(shredder.tallies) > BATCH:
                    yield shredder.take()
        yield shredder.take()

    return corpus.select("graph", "body").mapInArrow(run, SCHEMA)


@udtf(returnType=SCHEMA)
class prov_shred:  # noqa: N801
    """``SELECT * FROM corpus, LATERAL prov_shred(graph, body)``: the rows of each document, for SQL."""

    def eval(self, graph: str, body: str):
        shredder = _Shredder(DEFAULT, frozenset(WHATS), None)
        shredder.shred(graph, body)
        yield from shredder.rows


def errors(shredded: DataFrame) -> DataFrame:
    """(graph, reason) of rejected documents."""
    return shredded.where("what = 'error'").select("graph", shredded["text"].alias("reason"))
