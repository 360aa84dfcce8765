"""Corpora: discovery, shredding, native and interchange round trips, verification, growth."""

import json

import pytest
from documents import EDGES, FULL, NODES, ODD

from provweave import cli
from provweave.config import ProvConfig
from provweave.functions.jsontext import canonical
from provweave.operators import model, shred, stats
from provweave.plans import codec, harness, sql, workspace
from provweave.sources.provjson import ProvJsonSource, count_documents, list_documents, read_corpus


def docs(spark, values):
    return spark.createDataFrame([(f"g{i:03}.json", json.dumps(v, ensure_ascii=False)) for i, v in enumerate(values)], "graph string, body string")


def texts(df):
    return {r["graph"]: r["text"] for r in df.collect()}


def test_native_round_trip(spark):
    values = [FULL, *ODD, FULL]
    made = codec.compress(docs(spark, values))
    assert texts(made.decompress()) == {f"g{i:03}.json": canonical(v) for i, v in enumerate(values)}


def test_native_round_trip_through_parquet(spark, tmp_path):
    made = codec.compress(docs(spark, [FULL, *ODD]))
    made.write(str(tmp_path / "c"))
    again = codec.Compressed.read(spark, str(tmp_path / "c"))
    assert texts(again.decompress()) == texts(made.decompress())
    again.views()
    assert spark.sql("select count(*) from prov_dict").first()[0] > 0


def test_empty_corpus(spark):
    made = codec.compress(docs(spark, [FULL]).limit(0))
    assert made.decompress().count() == 0
    rows = shred.shred(docs(spark, [FULL]).limit(0))
    nodes = model.node_records(rows)
    totals = stats.corpus_totals(stats.graph_stats(rows, nodes), nodes, model.dictionary(rows)).first()
    assert totals["graphs"] == 0 and totals["orig_nodes"] == 0


def test_bad_documents_are_set_aside(spark):
    bad = [("a", "{"), ("b", '"text"'), ("c", None), ("d", '{"x": "\\ud800"}'), ("e", '{"entity": {}}'), ("f", "[" * 100_000), ("g", '{"a": 1, "a": 2}')]
    rows = shred.shred(spark.createDataFrame(bad, "graph string, body string"))
    found = {r["graph"]: r["reason"].split(":")[0] for r in shred.errors(rows).collect()}
    assert found == {"a": "malformed", "b": "top_level_string", "c": "missing", "d": "lone_surrogate", "f": "too_deep"}
    assert texts(codec.compress(spark.createDataFrame(bad, "graph string, body string")).decompress()) == {"e": '{"entity":{}}', "g": '{"a":2}'}


@pytest.mark.parametrize("order", ["lexical", "frequency", "first_seen"])
def test_ids_are_dense_and_ordered(spark, order):
    found = model.dictionary(shred.shred(docs(spark, [FULL, FULL])), ProvConfig(id_order=order)).orderBy("sid").collect()
    assert [r["sid"] for r in found] == list(range(len(found)))
    if order == "lexical":
        assert [r["s"] for r in found] == sorted(r["s"] for r in found)
    if order == "frequency":
        assert [r["n"] for r in found] == sorted((r["n"] for r in found), reverse=True)


def test_growth_keeps_ids(spark):
    first = codec.compress(docs(spark, [FULL]))
    old = {r["s"]: r["sid"] for r in first.tables["dict"].collect()}
    for values in ([FULL], [{"entity": {"brand new": {"prov:type": "never seen"}}}], [FULL, ODD[14]]):
        second = codec.compress(docs(spark, values), known=first)
        new = {r["s"]: r["sid"] for r in second.tables["dict"].collect()}
        assert all(new[s] == i for s, i in old.items()) and sorted(new.values()) == list(range(len(new)))
        assert texts(second.decompress()) == {f"g{i:03}.json": canonical(v) for i, v in enumerate(values)}


def test_counts(spark):
    rows = shred.shred(docs(spark, [FULL, {"used": [1, 2], "entity": {"a": 1}}]))
    found = {r["graph"]: r.asDict() for r in stats.graph_stats(rows, model.node_records(rows)).collect()}
    assert found["g000.json"]["orig_nodes"] == NODES and found["g000.json"]["orig_edges"] == EDGES
    assert found["g001.json"]["orig_nodes"] == 0 and found["g001.json"]["orig_edges"] == 2


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "in"
    names = ["task.json", "a b,#%.json", "_x.json", "_d/x.json", "my_corpus_manifest.json", "prov_manifest.json"]
    for i, name in enumerate([*names, "task.transcript.json", "manifest.json", "sub/corpus_manifest.json", "conformance_report.json", "checksums.sha256", ".x.json", ".h/x.json"]):
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(json.dumps(FULL | {"n": i}))
    (root / "bad.json").write_text("{")
    (root / "bom.json").write_bytes(b"\xef\xbb\xbf{}")
    return root, sorted([*names, "bad.json", "bom.json"])


def test_discovery(spark, tree):
    root, names = tree
    assert list_documents(spark, str(root)) == names and count_documents(spark, f"file://{root}") == len(names)
    assert sorted(r["graph"] for r in read_corpus(spark, str(root)).collect()) == names


def test_reading_a_corpus_starts_no_planner(spark, tree):
    root, names = tree
    (root / "odd.json").write_bytes(b"\xff{")
    (root / "empty.json").write_bytes(b"")
    found = read_corpus(spark, f"{root}/")
    plan = found._jdf.queryExecution().toString()
    assert "BatchScan" not in plan and "provjson" not in plan  # Python processes of the driver plan these, and stay
    spark.dataSource.register(ProvJsonSource)
    assert sorted(map(tuple, found.collect()), key=str) == sorted(map(tuple, spark.read.format("provjson").load(str(root)).collect()), key=str)
    assert {r["graph"]: r["read_error"] for r in found.where("read_error IS NOT NULL").collect()} == {"odd.json": "UnicodeDecodeError"}
    assert found.where("graph = 'empty.json'").first()["body"] == ""
    (root / "none").mkdir()
    assert read_corpus(spark, str(root / "none")).collect() == []


def test_directories_and_commands(spark, tree, tmp_path, capsys):
    root, names = tree
    out, back = str(tmp_path / "out"), str(tmp_path / "back")
    assert cli.main(["compress", "--input", str(root), "--out", out, "--verify"], spark) == 0
    totals = json.loads(capsys.readouterr().out)
    assert totals["graphs"] == len(names) - 2 and totals["lossless"] is True and totals["roundtrip_failures"] == 0
    assert cli.main(["decompress", "--input", out, "--out", back], spark) == 0
    assert json.loads(capsys.readouterr().out)["reconstructed_files"] == len(names) - 2
    for name in names[:3]:
        if name not in ("bad.json", "bom.json"):
            assert canonical(json.loads((tmp_path / "back" / name).read_text())) == canonical(json.loads((root / name).read_text()))
    assert cli.main(["verify", "--orig", str(root), "--compressed", out], spark) == 1  # the malformed ones have no reconstruction
    found = json.loads(capsys.readouterr().out)
    assert found["failures"] == 2 and sorted(found["mismatches"]) == ["bad.json", "bom.json"]
    for name in ("bad.json", "bom.json"):
        (root / name).unlink()
    assert cli.main(["verify", "--orig", str(root), "--compressed", out], spark) == 0
    header, *lines = (tmp_path / "out" / "benchmarks.csv").read_text().splitlines()
    assert header.startswith("graph,orig_nodes") and len(lines) == len(names) - 2
    with pytest.raises(FileExistsError):
        codec.compress_directory(spark, str(root), out)
    with pytest.raises(ValueError):
        codec.compress_directory(spark, str(root), str(root / "inside"))


def test_benchmark_command(spark, tree, tmp_path, capsys):
    root, _ = tree
    for name in ("bad.json", "bom.json"):
        (root / name).unlink()
    assert cli.main(["bench", "--corpus", str(root), "--output", str(tmp_path / "r"), "--pooled-name", "all"], spark) == 0
    saved = json.loads((tmp_path / "r" / "benchmark_results.json").read_text())
    assert saved["complete"] and len(saved["results"]) == 1 and 0 < saved["results"][0]["payload_bytes"]
    assert (tmp_path / "r" / "tables.tex").read_text().count("tabular") == 4


def test_views_are_what_the_tables_say(spark, tree, tmp_path):
    root, names = tree
    codec.compress_directory(spark, str(root), str(tmp_path / "out"))
    dumped = json.loads((tmp_path / "out" / "compressed_corpus.json").read_text())
    assert dumped["meta"]["dict_strings"] == len(dumped["dict"]) and dumped["meta"]["graphs"] == len(names) - 2
    view = json.loads((tmp_path / "out" / "compressed_graphs" / "task.json").read_text())
    assert set(view["entity"]) == {"_n"} and set(view["used"]) == {"_e"}


def test_a_store_that_only_hadoop_reads(spark, tree):
    root, names = tree
    spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.tests.link./in", f"file://{root}")
    with pytest.raises(ValueError):  # names that begin with _ are out of reach there
        read_corpus(spark, "viewfs://tests/in")
    for path in [p for p in names if "_x.json" in p or p.startswith("_")]:
        (root / path).unlink(missing_ok=True)
    rest = {p for p in names if not any(x.startswith("_") for x in p.split("/"))}
    (root / "bad.json").write_bytes(b"\xff{")
    found = {r["graph"]: r for r in read_corpus(spark, "viewfs://tests/in").collect()}
    assert set(found) == rest == set(list_documents(spark, "viewfs://tests/in"))
    assert found["task.json"]["body"] == (root / "task.json").read_text() and found["bad.json"]["body"] is None and found["bad.json"]["read_error"] == "UnicodeDecodeError"


def test_wanted_rows_and_sections(spark):
    corpus = docs(spark, [FULL, ODD[14]])
    rows = shred.shred(corpus).collect()
    some = shred.shred(corpus, want=["item"], sections=["used"]).collect()
    key = lambda r: (r["graph"], tuple(r["path"]), r["what"], r["section"], r["item"], r["fields"])
    assert sorted(map(key, some), key=repr) == sorted((key(r) for r in rows if r["section"] == "used" and r["what"] == "item"), key=repr)
    assert {tuple(r)[:-1] for r in shred.shred(corpus, want=["string"]).select("graph", "role", "text", "seq").collect()} == {(r["graph"], r["role"], r["text"]) for r in rows if r["what"] == "string"}
    with pytest.raises(ValueError):
        shred.shred(corpus, want=["nothing"])


@pytest.mark.parametrize("order", ["lexical", "frequency", "first_seen"])
def test_tallies_make_the_same_dictionary(spark, monkeypatch, order):
    corpus, config = docs(spark, [FULL, *ODD, FULL]).repartition(3), ProvConfig(id_order=order)
    whole = model.dictionary(shred.shred(corpus), config).collect()
    rows = shred.shred(corpus, want=[shred.TALLY])
    assert sorted(whole) == sorted(model.dictionary(rows, config).collect()) and rows.count() < sum(r["n"] for r in whole)


def test_functions_in_sql(spark):
    sql.register(spark)
    docs(spark, [FULL, ODD[9]]).createOrReplaceTempView("some_documents")
    assert spark.sql("select bool_and(prov_unpack(prov_pack(body)) = prov_canonical(body)) from some_documents").first()[0]
    n = spark.sql("select count(*) from some_documents, lateral prov_shred(graph, body)").first()[0]
    assert n == shred.shred(docs(spark, [FULL, ODD[9]])).count()


def test_pool_fit_and_figures(spark, tmp_path):
    zero = dict.fromkeys(("minified_bytes", "orig_nodes", "orig_edges", "total_supernodes", "dict_strings", "residual_nodes", "roundtrip_failures"), 0)
    made = [harness.Result(corpus=f"c_{i}", graphs=i, input_bytes=1000 * i, payload_bytes=250 * i, compress_s=2.0 * i + 1, decompress_s=1.0, peak_mb=10.0 * i, lossless=i < 3, **zero) for i in (3, 1, 2)]
    whole = harness.pool(made, "all")
    assert (whole.graphs, whole.input_bytes, whole.peak_mb, whole.lossless, round(whole.reduction, 6), whole.is_pooled) == (6, 6000, 30.0, False, 75.0, True)
    fit = stats.scaling_fit(harness.table(spark, made)).first()
    assert round(fit["slope"], 9) == 0.002 and round(fit["intercept"], 9) == 1.0 and round(fit["r2"], 9) == 1.0
    assert stats.scaling_fit(harness.table(spark, made[:2])).first()["slope"] is None
    saved = harness.save_figures(spark, [*made, whole], str(tmp_path))
    try:
        import matplotlib  # noqa: F401
    except ImportError:
        assert saved == []
    else:
        assert len(saved) == 6 and all((tmp_path / p.rsplit("/", 1)[1]).stat().st_size > 500 for p in saved)
    assert harness.percent(1, 0) == 0.0


def test_folders_on_a_cluster_must_be_shared(spark, monkeypatch):
    class Cluster:
        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

            @staticmethod
            def getConf():
                return {}

    with pytest.raises(ValueError):
        workspace.shared(Cluster)
    assert workspace.shared(Cluster, "/mnt/x/") == "/mnt/x"
