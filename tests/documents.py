"""Provenance documents for tests: made from the relation schema by a seeded generator, and odd ones by hand."""

import random

from provweave.config import NODE_SECTIONS, REL_SCHEMA, VOLATILE_ATTR_KEYS

#: What a field can be: no field at all, null, a string, a typed value, numbers, a boolean, a list.
ABSENT = object()
CHOICES = (ABSENT, None, "plain", {"$": "2031-05-06", "type": "xsd:date"}, 17, 2.25, False, ["x", 1, {"y": None}])


def value(rng, tag):
    found = rng.choice(CHOICES)
    return f"{tag}/{rng.randrange(6)}" if found == "plain" else found


def record(rng, names, tag):
    made = {n: value(rng, tag) for n in names}
    return {n: v for n, v in made.items() if v is not ABSENT}


def generated(seed, depth=2, size=4):
    """A document with all sections, every relation, each field in many states, and bundles ``depth`` deep."""
    rng = random.Random(seed)
    doc = {"prefix": {"q": f"urn:q:{seed}"}}
    volatile = sorted(VOLATILE_ATTR_KEYS)
    for section in NODE_SECTIONS:
        shared = [record(rng, ("prov:type", "q:role", "q:n"), section) for _ in range(2)]  # templates that recur
        doc[section] = {f"q:{section}{i}": rng.choice(shared) | record(rng, rng.sample(volatile, 3), f"v{i}") for i in range(size)}
    for relation, fields in REL_SCHEMA.items():
        doc[relation] = {f"_:{relation}{i}": record(rng, [*fields, "q:extra", "prov:label"], relation) for i in range(rng.randint(1, size))}
    doc["q:unknownRelation"] = {"_:z": record(rng, ("q:left", "q:right"), "z")}
    if depth:
        doc["bundle"] = {f"q:b{depth}{i}": generated(seed * 31 + i, depth - 1, 2) for i in range(2)} | {"q:nothing": {}}
    return doc


def states(doc):
    """How often each kind of cell stands in the relation columns of a document, bundles aside."""
    found = {}
    for relation, fields in REL_SCHEMA.items():
        for row in doc.get(relation, {}).values():
            for f in fields:
                kind = type(row[f]).__name__ if f in row else "absent"
                found[kind] = found.get(kind, 0) + 1
    return found


FULL = generated(11)
#: Nodes and edges of FULL, its bundles included.
_ALL = [FULL]
for _doc in _ALL:
    _ALL.extend(_doc.get("bundle", {}).values())
NODES = sum(len(d.get(s, {})) for d in _ALL for s in NODE_SECTIONS)
EDGES = sum(len(d.get(r, {})) for d in _ALL for r in REL_SCHEMA)

ODD = [
    {}, {"prefix": {}}, {"entity": {}}, {"bundle": {}}, {"$": 5}, {"$": "x"}, {"_n": "x"}, {"used": [{"a": 1}, "b"]},
    {"entity": {"e": {"$": 1, "#5": 2, "_n": [3], "_e": {}, "_b": None}}}, {"entity": {"e": [{"a": 1}, {"a": 2}]}},
    {"entity": {"a": {"x": 1}, "b": "no object"}}, {"used": {"u": 3}}, {"bundle": {"b": 1, "c": {}}}, {"bundle": {"b": {"bundle": {"c": {}}}}},
    {"entity": {"a": {"n": 1}, "b": {"n": 1.0}, "c": {"n": "1"}, "d": {"n": True}, "e": {"n": "true"}, "f": {"n": None}, "g": {"n": "null"}}},
    {"entity": {"a": {"v": -0.0, "w": 1e2, "x": 1.5e-7, "y": 10**44 + 7, "z": float("inf")}}},
    {"entity": {"😀": {"￮": "😀", "\u001f": 'q"\\\n\t\u0007', "é": 1}}}, {"used": {"u": {"prov:entity": 'a"b\\c\u0001\n', "prov:role": "é😀"}}},
    {"entity": {"s": {"prov:type": "t"}}, "agent": {"s": {"prov:type": "t"}}}, 1, 2.5, True, None, [1, "a", {"b": []}], [],
    {"used": {f"u{i}": {} if c is ABSENT else {"prov:entity": c} for i, c in enumerate(CHOICES)}},
]
