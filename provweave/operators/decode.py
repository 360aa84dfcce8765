"""Documents from facts: joins with the dimensions, then the rows of each document put together, no recursion."""

from __future__ import annotations

import itertools
import operator
from collections import defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .encode import ITEM
from .model import object_text


def node_texts(facts: DataFrame, dictionary: DataFrame, templates: DataFrame) -> DataFrame:
    """Nodes with their record: the pairs of the template merged with the node's own, as sorted arrays."""
    named = facts.drop("item").join(dictionary.select("sid", F.col("s").alias("item")), "sid")
    both = named.join(templates.select("tid", "shared"), "tid")
    return both.select(*ITEM, "section_json", "item_json", object_text(F.array_sort(F.concat("shared", "own"))).alias("record"))


def edge_texts(facts: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Fields of edges as (field, kv): string cells looked up, the rest as it is."""
    coded = facts.where("sid IS NOT NULL").join(dictionary.select("sid", "s"), "sid")
    cells = coded.select(*ITEM, "field", F.concat("field_json", F.lit(":"), json_string(F.col("s"))).alias("kv"))
    return cells.unionByName(facts.where("sid IS NULL").select(*ITEM, "field", F.concat("field_json", F.lit(":"), "json").alias("kv")))


def json_string(text: Column) -> Column:
    """A string as JSON, escaped as Python does with characters kept."""
    out = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    named = {"\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}
    for code in range(32):
        out = F.replace(out, F.lit(chr(code)), F.lit(named.get(chr(code), f"\\u{code:04x}")))
    escaped = F.when(text.rlike(r'[\x00-\x1f"\\]'), out).otherwise(text)  # few strings need any of it
    return F.concat(F.lit('"'), escaped, F.lit('"'))


#: What a row for ``assemble`` is about.
_DOC, _SECTION, _ITEM, _FIELD, _BUNDLE = range(5)
_ROW = ("hash", "graph", "path", "what", "section", "item", "name", "json")


def assemble(docs: DataFrame, sections: DataFrame, nodes: DataFrame, edges: DataFrame, fields: DataFrame, bundles: DataFrame, depth: int) -> DataFrame:
    """(graph, text): canonical text of each document, bundles folded in from the deepest up.

    ``nodes`` have their record, ``edges`` have theirs in ``fields``.  All rows of a document are brought together
    once, by its name, and follow one another; a worker holds those of one document.
    """
    none = F.lit(None).cast("string")
    path = F.when(F.size("path") > 0, F.col("path")).alias("path")

    def row(df: DataFrame, what: int, section, item, name, text) -> DataFrame:
        return df.select("graph", path, F.lit(what).alias("what"), *[(F.col(c) if isinstance(c, str) else c).alias(n) for c, n in zip((section, item, name, text), _ROW[4:])])

    rows = row(nodes, _ITEM, "section", "item", "item_json", "record")
    rows = rows.unionByName(row(edges, _ITEM, "section", "item", "item_json", none)).unionByName(row(fields, _FIELD, "section", "item", "field", "kv"))
    rows = rows.unionByName(row(sections, _SECTION, "section", none, "section_json", "json")).unionByName(row(docs, _DOC, none, none, none, "json"))
    if depth:
        rows = rows.unionByName(row(bundles, _BUNDLE, F.lit("bundle"), "item", "item_json", none))
    # sorted by one number, which needs no comparison of names; names that share it are told apart by the worker
    own = rows.repartition("graph").withColumn("hash", F.xxhash64("graph")).sortWithinPartitions("hash")
    return own.mapInArrow(_wholes, "graph string, text string")


def _wholes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of documents whose rows follow one another."""
    found = ((graph, text) for _, near in itertools.groupby(_in_order(batches), operator.itemgetter(0)) for graph, rows in _by_graph(near).items() for text in _texts(rows))
    while some := list(itertools.islice(found, 1000)):
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*some)], ["graph", "text"])


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[batch.column(c).to_pylist() for c in _ROW])


def _by_graph(rows: Iterable[tuple]) -> dict[str | None, list[tuple]]:
    found = defaultdict(list)
    for row in rows:
        found[row[1]].append(row)
    return found


def _texts(rows: Iterable[tuple]) -> list[str]:
    """Of the rows of a document, its text; of documents that share a name, one for each."""
    docs, heads, items, fields = defaultdict(list), defaultdict(list), defaultdict(dict), defaultdict(list)
    for _, _, path, what, section, item, name, text in rows:
        path = () if path is None else tuple(path)
        if what == _FIELD:
            fields[path, section, item].append((name, text))
        elif what == _SECTION:
            heads[path].append((section, name, text))
        elif what == _DOC:
            docs[path].append(text)
        else:
            items[path, section][item] = (name, text)
    for path in sorted(docs, key=len, reverse=True):
        full = []
        for section, name, text in sorted(heads[path], key=operator.itemgetter(0, 1)):
            if text is None:
                members = sorted(items.get((path, section), {}).items())
                text = "{" + ",".join([f"{n}:{_pairs(fields.get((path, section, item), ())) if own is None else own}" for item, (n, own) in members]) + "}"
            full.append(f"{name}:{text}")
        whole = "{" + ",".join(full) + "}"
        made = [whole if text is None else text for text in docs[path]]
        if not path:
            return made
        inside = items[path[:-1], "bundle"]
        if path[-1] in inside:
            inside[path[-1]] = (inside[path[-1]][0], made[0])
    return []


def _pairs(fields: Iterable[tuple[str, str]]) -> str:
    return "{" + ",".join([kv for _, kv in sorted(fields)]) + "}"
