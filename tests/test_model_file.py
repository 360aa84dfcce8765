"""Model files: written in parts, read as a stream, and never held by one process."""

import io
import json

import pytest

from provweave import compress_directory, decompress_directory, verify_directory
from provweave.functions.jsontext import members
from provweave.operators import views
from provweave.plans import codec

DOCS = {
    "a.json": {"entity": {"e,1": {"prov:type": "[x]", "prov:value": 'q"\\\n '}, "e2": {}}, "used": {"u": {"prov:activity": "a", "prov:entity": "e2", "odd": [1, "s"]}}},
    "b/c.json": {"bundle": {"b": {"agent": {"g": {"prov:type": {"$": "s", "type": "t"}}}}}, "other": ["s", 1.0, None]},
    "d.json": {},
}


def _write(root, docs):
    for name, doc in docs.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(json.dumps(doc, ensure_ascii=False))


@pytest.mark.parametrize("size", [1, 3, 1 << 20])
@pytest.mark.parametrize("indent", [None, 2])
def test_members_come_one_by_one(size, indent):
    whole = {"dict": ["a,b", "é\U0001f600", '"]', ""], "n": 1234567, "templates": [], "odd": {"dict": [1]}, "list": [1, 2]}
    found = list(members(io.BytesIO(json.dumps(whole, indent=indent, ensure_ascii=False).encode()), frozenset({"dict", "templates"}), size))
    assert found == [*[("dict", i, s) for i, s in enumerate(whole["dict"])], ("n", None, 1234567), ("odd", None, {"dict": [1]}), ("list", None, [1, 2])]
    assert list(members(io.BytesIO(b"{}"), frozenset())) == []


@pytest.mark.parametrize("text", ["", "[1]", '{"dict":["a",]}', '{"dict":["a"', '{"a":1} 2', '{"a" 1}'])
def test_what_is_no_object_is_refused(text):
    with pytest.raises(ValueError):
        list(members(io.BytesIO(text.encode()), frozenset({"dict"}), 4))


def test_the_file_is_the_model_of_the_documents(spark, tmp_path):
    _write(tmp_path / "in", DOCS)
    made = compress_directory(spark, str(tmp_path / "in"), str(tmp_path / "out"), verify=True)
    text = (tmp_path / "out" / codec.MODEL_FILE).read_text()
    whole = json.loads(text)
    assert text == json.dumps(whole, separators=(",", ":"), ensure_ascii=False)
    assert list(whole) == ["dict", "templates", "rel_schema", "meta"] and made["lossless"]
    assert len(whole["dict"]) == len(set(whole["dict"])) == whole["meta"]["dict_strings"]
    model = views.Model.load(whole)
    for name, doc in DOCS.items():
        assert model.decompress(json.loads((tmp_path / "out" / codec.VIEW_DIR / name).read_text())) == doc
    assert verify_directory(spark, str(tmp_path / "in"), str(tmp_path / "out")) == {"checked": 3, "failures": 0, "lossless": True, "mismatches": []}
    assert codec.model_members(spark, str(tmp_path / "out")) == {k: whole[k] for k in ("rel_schema", "meta")}


def test_a_tree_without_documents(spark, tmp_path):
    (tmp_path / "in").mkdir()
    compress_directory(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    assert json.loads((tmp_path / "out" / codec.MODEL_FILE).read_text())["dict"] == []


def test_another_layout_is_read(spark, tmp_path):
    own = codec.ProvCodec()
    _write(tmp_path / "c" / codec.VIEW_DIR, {n: own.compress(d) for n, d in DOCS.items()})
    dumped = own.dump_model()
    dumped = {k: dumped[k] for k in ("templates", "rel_schema", "dict")}
    (tmp_path / "c" / codec.MODEL_FILE).write_text(json.dumps(dumped, indent=1))
    assert decompress_directory(spark, str(tmp_path / "c"), str(tmp_path / "back")) == 3
    assert {n: json.loads((tmp_path / "back" / n).read_text()) for n in DOCS} == DOCS


def test_no_process_is_sent_the_model(spark, tmp_path, monkeypatch):
    _write(tmp_path / "in", DOCS)
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda *a: pytest.fail("the model was broadcast"))
    compress_directory(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    monkeypatch.setattr(views.Model, "load", lambda *a: pytest.fail("the model was loaded whole"))
    found = codec.load_model(spark, str(tmp_path / "out"))
    assert found.strings.count() == len(json.loads((tmp_path / "out" / codec.MODEL_FILE).read_text())["dict"])
    assert codec.read_compressed(spark, str(tmp_path / "out")).count() == 3
