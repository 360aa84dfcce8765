"""Source mixing against a plain version."""

import hashlib
import math
from collections import Counter, defaultdict

from samples import WORD, frame

from provweave.llm import mixing


def plain(rows, weights=(5, 2, 1), share=1.5, most=2.0):
    size = [len(WORD.findall(t or "")) for _, t, _, _ in rows]
    total = defaultdict(int)
    for n, r in zip(size, rows):
        total[r[3]] += n
    names = sorted(total, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, left, free = {}, share * sum(size), set(names)
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > most * total[s]}
        for s in over or free:
            target[s] = most * total[s] if over else level * weight[s]
        left -= sum(target[s] for s in over)
        free = free - over if over else set()
    taken = [0] * len(rows)
    for s in names:
        own = [i for i, r in enumerate(rows) if r[3] == s]
        own.sort(key=lambda i: (hashlib.md5(f"17:{'null' if rows[i][0] is None else rows[i][0]}".encode()).hexdigest(), rows[i][0] is not None, rows[i][0], size[i]))
        passes = math.floor(target[s]) // total[s] if total[s] else 0
        rest = math.floor(target[s]) - passes * total[s]
        for i in own:
            now = max(0, min(size[i], rest))
            taken[i], rest = passes * size[i] + now, rest - now
    return size, total, target, taken


def test_against_plain_version(spark, rows, docs):
    sized, cuts = mixing.plan(docs)
    got = {r["doc_id"]: r for r in mixing.taken(cuts, sized).collect()}
    size, total, target, taken = plain(rows)
    assert len(got) == len(rows)
    for r, n, t in zip(rows, size, taken):
        found = got[r[0]]
        assert (found["size"], found["source_size"], found["taken"]) == (n, total[r[3]], t)
        assert abs(found["target"] - target[r[3]]) < 1e-6 and found["taken"] <= 2 * n
    for s in total:
        assert abs(sum(t for r, t in zip(rows, taken) if r[3] == s) - target[s]) < 1


def test_repeated_rows_and_null_ids_share(spark):
    rows = [(1, "a b c d", "en", "x")] * 4 + [(None, "a b", "en", "x"), (None, "a b", "en", "x"), (2, "q " * 40, "en", "y")]
    sized, cuts = mixing.plan(frame(spark, rows))
    found = mixing.taken(cuts, sized).collect()
    assert len(found) == len(rows)
    assert len({r["taken"] for r in found if r["doc_id"] == 1}) == 1
    for s in ("x", "y"):
        own = [r for r in found if r["source"] == s]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) < 5


def test_empty(no_docs):
    sized, cuts = mixing.plan(no_docs)
    assert mixing.taken(cuts, sized).count() == 0 and mixing.apply(no_docs).count() == 0


def test_applied_mixture_repeats_and_drops(docs, rows):
    found = mixing.apply(docs)
    assert found.columns == docs.columns
    times = Counter(r["doc_id"] for r in found.collect())
    size, _, _, taken = plain(rows)
    for r, n, t in zip(rows, size, taken):
        assert times[r[0]] == (math.floor(t / n + 0.5) if n else 1)
