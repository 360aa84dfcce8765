"""Packages and shared models of single documents."""

import json

import pytest
from documents import CHOICES, FULL, ODD, states

from provweave.functions.jsontext import canonical
from provweave.operators import views
from provweave.plans.codec import ProvCodec, compress_document, decompress_document


def again(x):
    return json.loads(json.dumps(x))


def same(a, b):
    return canonical(a) == canonical(b)


def marks(view):
    return {k: next(iter(v)) for k, v in view.items() if isinstance(v, dict) and len(v) == 1}


def test_package_round_trip():
    assert same(decompress_document(again(compress_document(FULL))), FULL)


def test_shared_model_round_trip():
    codec = ProvCodec()
    coded = [codec.compress(FULL) for _ in range(3)]
    fresh = ProvCodec.from_model_json(codec.dump_model_json())
    assert all(same(fresh.decompress(again(v)), FULL) for v in coded)
    assert coded[1] == coded[2]


def test_all_relations_are_columns():
    view = views.Model().compress(FULL)
    found = marks(view)
    assert all(found[s] == "_n" for s in ("entity", "activity", "agent"))
    assert all(found[r] == "_e" for r in views.DEFAULT.rel_schema) and "q:unknownRelation" not in [k for k, m in found.items() if m == "_e"]
    assert found["bundle"] == "_b"
    inner = marks(view["bundle"]["_b"][1][0])
    assert inner["entity"] == "_n" and inner["used"] == "_e" and inner["bundle"] == "_b"


def test_the_generated_document_has_cells_of_every_kind():
    assert set(states(FULL)) == {"absent", "NoneType", "str", "dict", "int", "float", "bool", "list"}


def test_cells_tell_null_from_absent():
    doc = ODD[-1]  # one cell of each choice, the first absent, the second null
    _, columns, extras = views.Model().compress(doc)["used"]["_e"]
    cells = columns[1]
    assert cells[0] is None and cells[1] == [None] and isinstance(cells[2], int) and all(isinstance(c, list) and len(c) == 1 for c in cells[3:]) and set(extras) == {0}
    back = decompress_document(again(compress_document(doc)))["used"]
    assert "prov:entity" not in back["u0"] and back["u1"] == {"prov:entity": None} and [back[f"u{i}"]["prov:entity"] for i in range(1, len(CHOICES))] == list(CHOICES[1:])


def test_off_schema_values_keep_their_types():
    doc = {"hadMember": {"m": {"q:a": 0.5, "q:b": 3, "q:c": True, "q:d": None, "q:e": "3"}}}
    back = decompress_document(again(compress_document(doc)))["hadMember"]["m"]
    assert back == doc["hadMember"]["m"] and back["q:c"] is True and type(back["q:b"]) is int


@pytest.mark.parametrize("doc", ODD, ids=lambda d: canonical(d)[:40])
def test_odd_documents(doc):
    assert same(decompress_document(again(compress_document(doc))), doc)


def test_bare_strings_are_rejected():
    for text in ("", "x"):
        with pytest.raises(ValueError):
            views.Model().compress(text)


def test_equal_templates_are_shared_between_sections():
    model = views.Model()
    model.compress({"entity": {"a": {"prov:type": "t"}}, "agent": {"b": {"prov:type": "t", "prov:label": "l"}}})
    assert len(model.templates) == 1


def test_restored_model_goes_on_with_its_own_schema():
    dumped = ProvCodec().dump_model()
    dumped["rel_schema"] = {"used": ["prov:entity"]}
    codec = ProvCodec.from_model(dumped)
    doc = {"used": {"u": {"prov:entity": "e", "prov:activity": "a"}}, "hadMember": {"m": {"prov:entity": "x"}}}
    assert same(codec.decompress(again(codec.compress(doc))), doc)


def test_restored_model_keeps_sections_and_volatile_keys():
    config = views.ProvConfig(node_sections=("thing",), volatile_keys=frozenset({"q:n"}))
    own = ProvCodec(config)
    doc = {"thing": {"a": {"q:t": "x", "q:n": 1}, "b": {"q:t": "x", "q:n": 2}}, "entity": {"c": {"q:t": "x"}}}
    coded = own.compress(doc)
    fresh = ProvCodec.from_model_json(own.dump_model_json())
    assert fresh.model.config == config and fresh.compress(doc) == coded and same(fresh.decompress(again(coded)), doc)
    assert marks(coded)["thing"] == "_n" and "_n" not in coded["entity"]
