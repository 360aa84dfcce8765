"""Near-duplicates of texts and vectors against brute force."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from samples import WORD, frame, sentence

from provweave.llm import components, forest, setsketch


def groups(ids, linked):
    """Least reachable id of each id."""
    least = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            m = min(least[a], least[b])
            if least[a] != m or least[b] != m:
                least[a] = least[b] = m
                changed = True
    return least


def shingle_set(text, size):
    words = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def plain(rows, size, percent):
    own = [(i, shingle_set(t, size)) for i, t, *_ in rows]
    linked = [(a, b) for x, (a, s) in enumerate(own) for b, t in own[:x] if a is not None and b is not None and a != b and s and t and 100 * len(s & t) >= percent * len(s | t)]
    least = groups({i for i, _ in own if i is not None}, linked)
    return sorted(((i, len(s), least.get(i), i is None or least[i] == i) for i, s in own), key=repr)


def near_rows(seed, n=60):
    """Copies of copies with more and more edits around the threshold."""
    rng = random.Random(seed)
    base = sentence(rng, 120).split()
    rows = [(0, " ".join(base), None, None)]
    for i in range(1, n):
        words = rng.choice(rows)[1].split() if rng.random() < 0.4 else list(base)
        for _ in range(rng.randint(0, 14)):
            words[rng.randrange(len(words))] = sentence(rng, 1)
        rows.append((i, " ".join(words), None, None))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("size", [2, 5])
def test_documents(docs, rows, size):
    got = sorted((tuple(r) for r in setsketch.near_duplicates(docs, size).collect()), key=repr)
    assert got == plain(rows, size, 80)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_links_around_the_threshold(spark, seed, monkeypatch):
    monkeypatch.setattr(setsketch, "BLOCK", 7)  # bands are cut into blocks
    rows = near_rows(seed)
    got = sorted((tuple(r) for r in setsketch.near_duplicates(frame(spark, rows), 2).collect()), key=repr)
    assert got == plain(rows, 2, 80)


def test_equal_ids_null_ids_and_nothing(spark, no_docs):
    rng = random.Random(4)
    a, b = sentence(rng, 40), sentence(rng, 40)
    rows = [(5, a, None, None), (5, b, None, None), (7, a, None, None), (8, b, None, None), (None, a, None, None), (None, None, None, None), (9, "", None, None), (10, "", None, None)]
    got = {(r["doc_id"], r["n_shingles"]): (r["component_id"], r["kept"]) for r in setsketch.near_duplicates(frame(spark, rows)).collect()}
    assert got[7, 36] == got[8, 36] == (5, False) and got[5, 36] == (5, True) and got[None, 36] == (None, True) and got[9, 0] == (9, True) and got[10, 0] == (10, True)
    assert setsketch.near_duplicates(no_docs).count() == 0


def test_estimates_are_close():
    rng = np.random.default_rng(2)
    pool = rng.integers(0, 2**63, 4000).astype(np.uint64)
    for shared in (0, 300, 500, 800, 950, 1000):
        a, b = pool[:1000], np.concatenate([pool[:shared], pool[2000 : 3000 - shared]])
        s = [setsketch.registers(x, np.array([0])) for x in (a, b)]
        got = setsketch.estimate(*s, np.array([1000.0]), np.array([1000.0]))[0]
        assert abs(got - shared / (2000 - shared)) < 0.15
    union = setsketch.registers(np.concatenate([a, b]), np.array([0]))
    assert (union == np.maximum(*s)).all()  # mergeable


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(20)] + [(200, 200 + i) for i in range(30)] + [(None, 3)]
    got = {r["id"]: r["component"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    real = [(a, b) for a, b in links if a is not None and a != b]
    assert got == groups({i for e in real for i in e}, real)


SCHEMA = "vec_id long, embedding array<float>, label int, copies int, hash string, rep long"


def vectors(seed=1):
    rng = np.random.default_rng(seed)
    rows = [(i, rng.standard_normal(16), i % 3) for i in range(150)]
    centre = rng.standard_normal(16)
    rows += [(200 + i, centre + rng.standard_normal(16) * s, 1) for i, s in enumerate(np.linspace(0.0, 0.25, 120))]
    rows += [(400, rows[3][1], 0), (401, rows[3][1], 0), (402, rows[3][1] * 2, 0), (403, rows[3][1], 1)]
    out = [(int(i), [float(np.float32(x)) for x in v], label) for i, v, label in rows]
    odd = [(500, None, 1), (501, [0.0] * 16, 1), (502, [float("nan")] * 16, 1), (503, [1.0, None], 1), (504, out[3][1], None), (505, [float("inf")] * 16, 1), (506, [], 1), (507, [1.0, 2.0], 1), (508, [1.0, 2.0], 1), (None, out[3][1], 0)]
    return out + odd


def cosines(rows, least):
    fine = [(i, np.array(v, np.float64), label) for i, v, label in rows if i is not None and v and label is not None and None not in v and np.isfinite(v).all() and np.any(v)]
    for x, (a, v, label) in enumerate(fine):
        for b, w, other in fine[:x]:
            if label == other and len(v) == len(w) and v @ w / (np.linalg.norm(v) * np.linalg.norm(w)) >= least:
                yield a, b


def check_vectors(spark, rows, least=0.98):
    df = spark.createDataFrame([(i, v, label, 1, "h", 5) for i, v, label in rows], SCHEMA)
    got = {}
    for r in forest.near_duplicates(df, least).collect():
        got.setdefault(r["vec_id"], set()).add((r["n_links"], r["component_id"], r["kept"]))
    linked = list(cosines(rows, least))
    component = groups({r[0] for r in rows if r[0] is not None}, linked)
    degree = Counter(x for e in linked for x in e)
    for i in {r[0] for r in rows}:
        assert got[i] == {(degree[i], component.get(i), i is None or component[i] == i)}, i


@pytest.mark.parametrize("sizes", [{}, {"BLOCK": 20}, {"LEAF": 8, "SAMPLE": 40, "CHUNK": 30, "LARGE": 16}])
def test_vectors(spark, monkeypatch, sizes):
    for name, value in sizes.items():
        monkeypatch.setattr(forest, name, value)
    check_vectors(spark, vectors())


def test_equal_ids_of_one_vector(spark):
    v = vectors()[0][1]
    check_vectors(spark, [(1, v, 0), (2, v, 0), (3, [-x for x in v], 0)])
    df = spark.createDataFrame([(7, v, 0, 1, "h", 5), (7, v, 0, 1, "h", 5), (7, [-x for x in v], 0, 1, "h", 5), (8, v, 0, 1, "h", 5)], SCHEMA)
    assert sorted(tuple(r) for r in forest.near_duplicates(df).collect()) == [(7, 0, 7, True), (7, 2, 7, True), (7, 2, 7, True), (8, 2, 7, False)]


def test_trees_split_and_find_nearly_all_of_20000_vectors(spark):
    """Recall of pairs at and above the threshold, against all pairs; leaves stay small without a bound on depth."""
    rng = np.random.default_rng(8)
    centres = rng.standard_normal((400, 24))
    x = centres[rng.integers(0, 400, 20_000)] + rng.standard_normal((20_000, 24)) * rng.uniform(0.02, 0.3, (20_000, 1))
    df = spark.createDataFrame(pa.table({"vec_id": pa.array(np.arange(20_000)), "embedding": pa.array(list(x)), "label": pa.array(np.minimum(np.arange(20_000) % 7, 3), pa.int32())}))
    got = {r["vec_id"]: r["n_links"] for r in forest.near_duplicates(df).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    label = np.minimum(np.arange(20_000) % 7, 3)
    want = np.zeros(20_000, int)
    for a in range(0, 20_000, 1000):
        near = (unit[a : a + 1000] @ unit.T >= 0.98) & (label[a : a + 1000, None] == label)
        want[a : a + 1000] = near.sum(1) - 1
    found = np.array([got[i] for i in range(20_000)])
    assert (found <= want).all() and want.sum() > 100_000
    assert found.sum() / want.sum() >= 0.999


def test_trees_split_in_the_smallest_tables(spark):
    vectors_ = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    _, classes = forest._classes(vectors_)
    at = forest.leaves(classes.select("cid", "label", "vector"), 64, 0.02)
    n_labels, n, cells = vectors_.select("label").distinct().count(), classes.count(), at.select("cell").distinct().count()
    assert cells > 2 * forest.TREES * n_labels and at.groupBy("cell").count().agg({"count": "max"}).first()[0] < n / n_labels


def test_no_vectors(spark):
    assert forest.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    assert forest.near_duplicates(spark.createDataFrame([(1, None, None, 1, "h", 5)], SCHEMA)).first()["kept"]
