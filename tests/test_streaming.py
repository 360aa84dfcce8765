"""Incremental compaction of a stream."""

import json

from documents import FULL, ODD

from provweave.functions.jsontext import canonical
from provweave.streaming import ingest


def test_batches_share_one_model(spark, tmp_path):
    source, root = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    schema = "graph string, body string"
    values = [FULL, ODD[14], {"entity": {"new": {"prov:type": "x"}}}]
    for i, v in enumerate(values):
        spark.createDataFrame([(f"{i}", json.dumps(v))], schema).write.mode("append").json(str(source))
        query = ingest.start(spark.readStream.schema(schema).json(str(source)), root, str(tmp_path / "check"))
        query.awaitTermination()
        assert query.exception() is None
    whole = ingest.load(spark, root)
    assert {r["graph"]: r["text"] for r in whole.decompress().collect()} == {f"{i}": canonical(v) for i, v in enumerate(values)}
    ids = [r["sid"] for r in whole.tables["dict"].collect()]
    assert sorted(ids) == list(range(len(ids)))


def test_a_batch_run_again_changes_nothing(spark, tmp_path):
    root = str(tmp_path / "out")
    batch = spark.createDataFrame([("a", json.dumps(FULL))], "graph string, body string")
    ingest.compact_batch(batch, 0, root)
    ingest.compact_batch(batch, 0, root)
    assert ingest.load(spark, root).tables["doc"].where("size(path) = 0").count() == 1


def test_models_are_merged_and_go_on(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ingest, "MERGE", 2)
    root, everything = str(tmp_path / "m"), []
    for i in range(5):
        batch = [(f"g{i}{k}", json.dumps({"entity": {f"e{i % 3}": {"prov:type": f"t{k}", "prov:value": i}}})) for k in range(3)]
        everything += batch
        ingest.compact_batch(spark.createDataFrame(batch, "graph string, body string"), i, root)
    assert ingest._done(spark, root, "merged") == [1, 3]
    whole = ingest.load(spark, root)
    ids = [r["sid"] for r in whole.tables["dict"].collect()]
    assert sorted(ids) == list(range(len(ids)))  # no string twice, none left out
    assert {r["graph"]: r["text"] for r in whole.decompress().collect()} == {g: canonical(json.loads(b)) for g, b in everything}
    assert ingest.known_model(spark, root, 5).tables["dict"].count() == len(ids)
