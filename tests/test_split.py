"""What a compressed corpus needs of the shredder, and how its rows travel to Python workers and back into documents."""

import json
from types import SimpleNamespace

import pyarrow as pa
import pytest
from documents import FULL, ODD
from pyspark.sql import functions as F

from provweave.config import DEFAULT
from provweave.functions.jsontext import canonical, parse
from provweave.operators import decode, encode, model, shred, stable
from provweave.plans import codec

NODE = {"prov:type": "t", "prov:value": 1.0, "é": {"b": [1, None], "a": "x"}}


def _docs(spark, values):
    return spark.createDataFrame([(f"g{i}", json.dumps(v)) for i, v in enumerate(values)], "graph string, body string")


def test_split_items_say_what_whole_items_say(spark):
    corpus = _docs(spark, [FULL, {"entity": {"a": NODE}, "used": {"u": {"prov:entity": "a", "prov:role": 1, "x": "y"}}}, *ODD])
    whole, split = shred.shred(corpus, want=["item"]), shred.shred(corpus, want=[shred.SPLIT])
    columns = ["graph", "path", "section", "item", "section_json", "item_json", "item_ord", "seq", "template", "own"]
    nodes = model.node_records(whole).select(*columns)
    found = model.split_nodes(split)
    assert sorted(map(repr, found.select(*columns).collect())) == sorted(map(repr, nodes.collect()))
    pairs = found.select("template", model.template_pairs("template").alias("shared")).distinct()
    assert sorted(map(repr, pairs.collect())) == sorted(map(repr, model.node_records(whole).select("template", "shared").distinct().collect()))
    strings = model.dictionary(shred.shred(corpus, want=[shred.TALLY]))
    facts = lambda rows: sorted(map(repr, encode.edge_facts(rows, strings).collect()))
    assert facts(split) == facts(whole)
    with pytest.raises(ValueError):
        shred.shred(corpus, want=["item", shred.SPLIT])


def test_stored_rows_reach_workers_in_small_batches(spark, tmp_path, monkeypatch):
    conf = spark.sparkContext.getConf().set("spark.checkpoint.dir", f"file://{tmp_path}/shared")
    monkeypatch.setattr(type(spark.sparkContext), "getConf", lambda self: conf)

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], ["n"])

    rows = spark.range(0, 5000, 1, 1).mapInArrow(sizes, "n long")
    assert stable.stable(rows).agg(F.max("n"), F.sum("n")).first()[:] == (stable.ROWS, 5000)
    assert rows.agg(F.max("n")).first()[0] == 5000  # the caller's setting is as it was


def test_documents_whose_hash_is_the_same_stay_apart():
    row = lambda graph, what, section=None, item=None, name=None, text=None, path=None: (7, graph, path, what, section, item, name, text)
    rows = [
        row("a", decode._DOC), row("b", decode._DOC), row("b", decode._SECTION, "used", None, '"used"'), row("a", decode._SECTION, "x", None, '"x"', "[1]"),
        row("b", decode._ITEM, "used", "v", '"v"'), row("b", decode._FIELD, "used", "u", "k", '"k":1'), row("b", decode._ITEM, "used", "u", '"u"'), row("b", decode._FIELD, "used", "u", "a", '"a":2'),
    ]
    batch = pa.RecordBatch.from_pylist([dict(zip(decode._ROW, r)) for r in rows], pa.schema([(n, pa.int64() if n in ("hash", "what") else pa.list_(pa.string()) if n == "path" else pa.string()) for n in decode._ROW]))
    found = {r["graph"]: r["text"] for out in decode._wholes([batch.slice(0, 5), batch.slice(5)]) for r in out.to_pylist()}
    assert found == {"a": '{"x":[1]}', "b": '{"used":{"u":{"a":2,"k":1},"v":{}}}'}


@pytest.mark.parametrize("text, reason", [('{"a":"\\ud800"}', "lone_surrogate"), ('{"a":"\\uD83D\\uDE00"}', None), ("\ud800", "malformed"), ('{"a":"\ud800"}', "lone_surrogate"), ("[" * 100_000 + "]" * 100_000, "too_deep"), ("[" * 300 + "]" * 300, None)])
def test_what_can_not_be_written_again_is_told(text, reason):
    value, found = parse(text)
    assert (found or "").startswith(reason or "") and (reason is None) == (found is None)
    if reason is None:
        assert json.loads(canonical(value)) == value


def test_a_few_million_items_are_not_decoded_in_many_shares(monkeypatch):
    monkeypatch.setattr(codec, "stores", lambda spark: True)
    shares = lambda n: codec.Compressed({"dict": SimpleNamespace(sparkSession=None)}, DEFAULT, 0, items=n)._shares()
    assert [shares(n) for n in (0, 2_000_000, 3_150_000, 1_000_000_000)] == [1, 1, 2, codec.MOST_SHARES]  # the third is sf0.1's commerce
