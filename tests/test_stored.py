"""What is stored between steps: how, how long, and what needs nothing stored."""

import json
import os
import time

import pytest
from pyspark.sql import functions as F

from provweave import compress_directory
from provweave.functions.jsontext import canonical
from provweave.operators import lineage, model, shred, stable, stats
from provweave.plans import codec, corpora, stored

DOC = {"entity": {"a": {"prov:type": "t"}, "b": {"prov:type": "t", "prov:value": 1}, "c": {}}, "agent": {"g": {"prov:type": "t"}}, "used": {"u": {"prov:activity": "x", "prov:entity": "a"}, "v": {"prov:activity": "a", "prov:entity": "x"}, "w": {"prov:activity": "x", "prov:entity": "b"}}, "wasInformedBy": [1, 2]}


@pytest.fixture
def nothing_stored(monkeypatch):
    for module in (lineage, stats, shred, stable):
        monkeypatch.setattr(module, "stable", lambda df: pytest.fail("stored"), raising=False)


@pytest.fixture
def folder(spark, tmp_path, monkeypatch):
    """A shared folder, as a cluster has it."""
    conf = spark.sparkContext.getConf().set("spark.checkpoint.dir", f"file://{tmp_path}/shared")
    monkeypatch.setattr(type(spark.sparkContext), "getConf", lambda self: conf)
    return tmp_path / "shared"


def _docs(spark, *docs):
    return spark.createDataFrame([(g, json.dumps(d)) for g, d in docs], "graph string, body string")


def test_counts_take_one_pass(spark, nothing_stored):
    rows = shred.shred(_docs(spark, ("d", DOC), ("e", {}), ("f", {"used": {}}), ("d", {"entity": {"z": {"prov:type": "t"}}})))
    once = stats.graph_stats(rows)
    assert once._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    found = {r["graph"]: r[1:] for r in once.collect()}
    assert found == {"d": (5, 5, 2, 5, 1, 0.4, 1.0), "e": (0, 0, 0, 0, 0, 0.0, 1.0), "f": (0, 0, 0, 0, 0, 0.0, 1.0)}
    assert {r["graph"]: r[1:] for r in stats.graph_stats(rows, model.node_records(rows)).collect()} == found


def test_links_are_followed_without_tables_between(spark, nothing_stored):
    rows = shred.shred(_docs(spark, ("d", DOC), ("e", {"used": {f"u{i}": {"prov:activity": f"n{i}", "prov:entity": f"n{i + 1}"} for i in range(60)}})))
    links = lineage.edges(rows)
    starts = spark.createDataFrame([("d", "x"), ("e", "n0"), ("e", "nowhere")], "graph string, source string")
    found = lineage.reachable(links, starts)
    assert sorted(found.where("graph = 'd'").collect()) == [("d", "x", "a", 1), ("d", "x", "b", 1)]
    assert sorted(found.where("graph = 'e'").select("reached", "hops").collect()) == sorted((f"n{i}", i) for i in range(1, 51))
    repeated = lineage.edges(rows, distinct=False).unionByName(links)
    assert sorted(lineage.reachable(repeated, F.col("source") == "x").collect()) == [("d", "x", "a", 1), ("d", "x", "b", 1)]
    assert lineage.reachable(links, starts.where("false")).count() == 0


def test_stored_rows_are_compact(spark, folder):
    docs = _docs(spark, *[(f"g{i}", DOC) for i in range(300)])
    rows = shred.shred(docs)
    kept = stable.stable(rows)
    size = sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(folder) for f in names)
    assert 0 < size < docs.agg(F.sum(F.length("body"))).first()[0]
    assert kept.schema == rows.schema and kept.exceptAll(rows).isEmpty() and rows.exceptAll(kept).isEmpty()


def test_directory_work_leaves_nothing_stored(spark, folder, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text(json.dumps(DOC))
    assert compress_directory(spark, str(tmp_path / "in"), str(tmp_path / "out"), verify=True)["lossless"]
    assert list(folder.iterdir()) == []


def test_shuffle_files_go_with_what_is_stored(spark, folder):
    held = lambda: {x for x in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n") if "/shuffle_" in x}
    before = held()
    assert len(stable.stable(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()).collect()) == 7
    ends = time.time() + 10
    while held() - before and time.time() < ends:  # files are removed in the background
        time.sleep(0.1)
    assert not held() - before
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_a_document_is_brought_together_once(spark, folder):
    nested = {"bundle": {"b": {"bundle": {"c": {**DOC, "bundle": {}}, "d": {}}, "used": {}}}, "agent": {}, "x": [1, "y"]}
    values = [DOC, nested, {}, [1], {"used": {"u": {}}, "entity": {"e": {}}}]
    made = codec.compress(_docs(spark, *[(str(i), v) for i, v in enumerate(values)]))
    stored = len(list(folder.iterdir()))
    assert {r["graph"]: r["text"] for r in made.decompress().collect()} == {str(i): canonical(v) for i, v in enumerate(values)}
    assert len(list(folder.iterdir())) == stored + 2  # texts of nodes and of fields; what they came from is gone
    flat = codec.compress(_docs(spark, ("d", DOC))).decompress()
    assert flat._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(") == 1


@pytest.mark.parametrize("name", ["dialogue", "telemetry", "commerce"])
def test_a_corpus_is_made_by_shares(spark, tmp_path, monkeypatch, name):
    for t in ("conversations", "events", "orders", "lineitem", "customer", "part"):
        some = spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet")
        if t in corpora.KEYS[name]:
            key = corpora.KEYS[name][t]
            some = some.withColumn(key, F.when(F.col(key) % 9 != 2, F.col(key)))  # no key is a key too
        some.write.parquet(f"{tmp_path}/{t}.parquet")
    written, whole = [], getattr(corpora, name)(spark, str(tmp_path))
    monkeypatch.setattr(stored, "SHARE", 1)
    monkeypatch.setattr(stored, "MOST", 3)
    monkeypatch.setattr(corpora, name, lambda s, d, share, made=getattr(corpora, name): written.append(share) or made(s, d, share))
    found = stored.corpus(spark, str(tmp_path), name)
    assert written == [(0, 3), (1, 3), (2, 3)]
    assert 1 < found.count() == whole.count() and found.exceptAll(whole).isEmpty()


def test_large_corpora_are_decoded_by_shares(spark, folder, monkeypatch):
    nested = {"bundle": {"b": {"bundle": {"c": {**DOC, "bundle": {}}, "d": {}}, "used": {}}}, "agent": {}, "x": [1, "y"]}
    values = [DOC, nested, {}, [1], {"used": {"u": {}}, "entity": {"e": {}}}]
    monkeypatch.setattr(codec, "ITEMS_AT_ONCE", 6)
    made = codec.compress(_docs(spark, *[(str(i), v) for i, v in enumerate(values)]))
    before, shares = len(list(folder.iterdir())), made._shares()
    assert shares == 4
    texts = made.decompress()
    assert len(list(folder.iterdir())) == before + shares  # a share's text is all that is left of it
    assert "Exchange" not in texts._jdf.queryExecution().executedPlan().toString()
    assert {r["graph"]: r["text"] for r in texts.collect()} == {str(i): canonical(v) for i, v in enumerate(values)}
    made.write(f"{folder}/kept")
    again = codec.Compressed.read(spark, f"{folder}/kept")
    assert again._shares() > 1 and {r["graph"]: r["text"] for r in again.decompress().collect()} == {str(i): canonical(v) for i, v in enumerate(values)}
