"""Substring and suffix-array dedup against brute force."""

import hashlib
import random

import numpy as np
import pytest
from samples import WORD, frame, sentence

from provweave.llm import repeats, substring, suffixes


def windows_removed(items, n, docs):
    """Covered positions of each (id, sequence): windows that start in a smaller id too."""
    first = {}
    for i, seq in docs:
        for s in range(len(seq) - n + 1):
            w = seq[s : s + n]
            first[w] = min(first.get(w, i), i)
    out = []
    for i, seq in items:
        gone = set()
        for s in range(len(seq) - n + 1):
            if first[seq[s : s + n]] < i:
                gone.update(range(s, s + n))
        out.append(gone)
    return out


def last(i):
    return float("inf") if i is None else i


def check_words(spark_docs, rows, n):
    docs = [(last(i), tuple(WORD.findall(t or ""))) for i, t, *_ in rows]
    want = []
    for (i, t, *_), (_, words), gone in zip(rows, docs, windows_removed(docs, n, docs)):
        kept = " ".join(w for k, w in enumerate(words) if k not in gone)
        want.append((i, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    got = [tuple(r) for r in substring.dedup(spark_docs, n).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def check_bytes(spark_docs, rows, n, k):
    docs = [(last(i), (t or "").encode()) for i, t, *_ in rows]
    want = []
    for (i, *_), (_, raw), gone in zip(rows, docs, windows_removed(docs, n, docs)):
        kept = bytes(b for p, b in enumerate(raw) if p not in gone)
        spans = sum(p - 1 not in gone for p in gone)
        want.append((i, len(raw), len(gone), spans, hashlib.sha256(kept).hexdigest(), kept))
    got = [(*tuple(r)[:5], bytes(r["kept"])) for r in suffixes.dedup(spark_docs, n, k).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("n", [50, 9, 4, 3])
def test_words(docs, rows, n):
    check_words(docs, rows, n)


@pytest.mark.parametrize("n,k", [(50, 24), (20, 9), (10, 3)])
def test_bytes(docs, rows, n, k):
    check_bytes(docs, rows, n, k)


@pytest.mark.parametrize("frequent", [0, 3])
def test_frequent_stretches_go_window_by_window(spark, docs, rows, monkeypatch, frequent):
    monkeypatch.setattr(repeats, "FREQUENT", frequent)
    check_bytes(docs, rows, 50, 24)
    rng = random.Random(9)
    passage = sentence(rng, 40)
    own = [(i, f"{sentence(rng, 4)} {passage} {sentence(rng, 4)}", None, None) for i in range(60)]
    check_bytes(frame(spark, own), own, 50, 24)
    layout = repeats.Layout(frame(spark, own))
    sizes = suffixes.surroundings(layout, layout.texts(frame(spark, own)), 50, 24).where("kind = 0").collect()
    columns, _ = suffixes._unwrap([bytes(r["packed"]) for r in sizes])
    assert (columns[-1] == 50).any() and (columns[-1] > 50).mean() < 0.5  # mostly single windows


def test_every_removal_comes_from_the_sorted_suffixes(rows):
    """With the classes of the sort made empty, nothing is removed."""
    rng, n = random.Random(2), 10
    texts = [sentence(rng, 12) for _ in range(4)]
    raw = [(d, t.encode()) for d, t in enumerate([texts[0], texts[1], texts[0], texts[0] + texts[2], texts[1], texts[3] + texts[0]])]
    data = np.frombuffer(b"".join(x for _, x in raw), np.uint8)
    size = np.array([len(x) for _, x in raw])
    start, doc = np.cumsum(size) - size, np.array([d for d, _ in raw])
    whole = suffixes.blocks.mix(suffixes.blocks.span(suffixes.blocks.prefix(data), start, start + size))
    # all share one anchor and, as their windows need equal distances, stand at their common place
    lead = np.array([0, 0, 0, 0, 0, len(texts[3].encode())])
    arguments = (data, np.zeros(6, np.uint64), lead, whole, doc, start.astype(np.uint64), start, size, n)
    heads, (gone, _, windows) = suffixes.settle(*arguments)
    assert sorted(heads) == [0, 1, 3, 5] and {2, 3, 4, 5} == set(gone.tolist())
    assert windows[gone == 2].tolist() == [size[2] - n + 1] and windows[gone == 5].sum() == size[0] - n + 1
    sort, suffixes._sorted_out = suffixes._sorted_out, lambda flat, cuts, *rest: np.full(int((np.diff(cuts) - n + 1).sum()), 99)
    try:
        assert len(suffixes.settle(*arguments)[1][0]) == 0
    finally:
        suffixes._sorted_out = sort


@pytest.mark.parametrize("partitions", [1, 200])
def test_any_number_of_partitions_and_null_ids(spark, rows, partitions):
    own = rows + [(None, r[1], None, None) for r in rows[:6]] + [(None, rows[0][1], None, None)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        layout = repeats.Layout(frame(spark, own))
        assert layout.parts == layout.buckets == 2 * spark.sparkContext.defaultParallelism + 1
        check_words(frame(spark, own), own, 50)
        check_bytes(frame(spark, own), own, 50, 24)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_other_kinds_of_ids_are_refused(spark):
    with pytest.raises(TypeError):
        substring.dedup(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


def test_random_small_alphabets(spark):
    rng = random.Random(3)
    for trial in range(3):
        rows = [(rng.choice([*range(30), None]), " ".join(rng.choice("ab") for _ in range(rng.randint(0, 40))), None, None) for _ in range(40)]
        check_words(frame(spark, rows), rows, 7 + trial)
        check_bytes(frame(spark, rows), rows, 12 + trial, 5)


def test_many_copies_of_one_passage(spark):
    rng = random.Random(5)
    passage = sentence(rng, 60)
    rows = [(i, f"{sentence(rng, 5)} {passage} {sentence(rng, 5)}", None, None) for i in range(120)]
    check_words(frame(spark, rows), rows, 50)
    check_bytes(frame(spark, rows), rows, 50, 24)


def test_sorted_in_small_pieces(spark, monkeypatch, rows):
    own = [r for r in rows if r[0] < 27]
    monkeypatch.setattr(suffixes, "SORTED", 3)
    check_bytes(frame(spark, own), own, 50, 24)


def test_collisions_remove_nothing(spark):
    s = suffixes.Suffixes(np.frombuffer(b"abcdefgabcdxyz", np.uint8), 4)
    assert s.common(np.array([0, 0]), np.array([7, 1])).tolist() == [4, 0]
    assert s.equal_bytes(np.array([0, 0]), np.array([7, 8])).tolist() == [True, False]
    at = s.mergesort(np.arange(10), np.zeros(10, int))
    assert [bytes(s.data[i : i + 4]) for i in at] == sorted(bytes(s.data[i : i + 4]) for i in range(10))


def test_nothing(no_docs):
    assert substring.dedup(no_docs).count() == 0 and suffixes.dedup(no_docs).count() == 0
