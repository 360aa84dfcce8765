"""The classifier against brute force, and held-out labels."""

import os
import re
import zlib

import numpy as np
import pytest
from samples import frame
from pyspark.sql import functions as F

from provweave.llm import q_quality, quality

SF = "/root/testdata/sf0.01"


def junk(i):
    return ["CAPS!! WORDS!! ONLY!! HERE!! " * 9, "one | two | three | four | " * 9, "bad### worse$$$ worst&&& " * 9][i % 3]


@pytest.fixture(scope="module")
def model(spark, rows):
    texts = [(i, t, None, None) for i, t, _, _ in rows if t and len(t) > 200 and i < 27] + [(100 + i, junk(i) + str(i), None, None) for i in range(12)]
    labels = spark.createDataFrame([(i, 1 if i < 100 else 0) for i, *_ in texts] + [(100, None), (None, 1)], "doc_id long, label int")
    return quality.fit(frame(spark, texts), labels, neighbours=5)


MARKS = [c for c in map(chr, range(33, 127)) if not c.isalnum()]


def shape(c):
    """The shape of a character, from its definition."""
    kinds = {"\n": 5, "\t": 6, "\x0b": 6, "\x0c": 6, "\r": 6, " ": 6} | {m: 7 + i for i, m in enumerate(MARKS)}
    return kinds.get(c, 4 if ord(c) > 127 else 1 if c.islower() else 2 if c.isupper() else 3 if c.isdigit() else 0)


def plain_shares(text):
    """Square roots of term shares by plain counting."""
    out, shapes, words = np.zeros(quality.TERMS), [shape(c) for c in text or ""], re.findall(r"[^\x20\x09-\x0D]+", text or "")
    for a, b, c, d in zip(shapes, shapes[1:], shapes[2:], shapes[3:]):
        gram = ((a * 61 + b) * 61 + c) * 61 + d
        out[(gram * 2654435761 % 2**32 >> 11) % quality.GRAMS] += 1
    out[quality.GRAMS] = sum(len(w.encode()) for v, w in zip(words, words[1:]) if v == w)
    seen = set()
    for three in zip(words, words[1:], words[2:]):
        if three in seen:
            out[quality.GRAMS + 1] += len(three[0].encode())
        seen.add(three)
    return np.sqrt(out / max(out.sum(), 1))


def test_scores_equal_plain_voting(spark, rows, docs, model):
    """Features, decomposition and votes made anew, from the same labelled texts."""
    learnt = [(t, 1) for i, t, _, _ in rows if t and len(t) > 200 and i < 27] + [(junk(i) + str(i), 0) for i in range(12)]
    labels = [y for _, y in learnt]
    sample = np.array([plain_shares(t) for t, _ in learnt])
    _, values, axes = np.linalg.svd(sample, full_matrices=False)
    axes = axes[values > 1e-6][:48].T
    latent = sample @ axes
    latent /= np.linalg.norm(latent, axis=1, keepdims=True)
    got = {r["doc_id"]: r["score"] for r in quality.score(docs, model).collect()}
    assert len(got) == len(rows) and len(model.labels) == len(learnt) and model.neighbours == 5
    for i, text, _, _ in rows:
        x = plain_shares(text) @ axes
        norm = np.linalg.norm(x)
        cosine = [float(x @ v / norm) if norm else 0.0 for v in latent]
        near = sorted(range(len(cosine)), key=lambda k: -cosine[k])[:5]
        weight = [max(cosine[k], 0) ** model.power for k in near]
        want = sum(w * labels[k] for w, k in zip(weight, near)) / sum(weight) if sum(weight) > 0 else np.mean(labels)
        assert 0 <= got[i] <= 1 and abs(got[i] - want) < 0.02, (i, got[i], want)


def test_the_sample_is_bounded_and_repeatable(spark, docs, rows):
    twice = docs.unionByName(docs)
    labels = spark.createDataFrame([(i, i % 2) for i in range(12)], "doc_id long, label int")
    models = [quality.fit(d, labels, sample=7) for d in (twice, twice.repartition(5))]
    assert len(models[0].labels) == 7 and (models[0].vectors == models[1].vectors).all() and (models[0].labels == models[1].labels).all()


def test_repeated_rows_and_clashing_names(spark, docs, model):
    odd = docs.withColumnsRenamed({"key": "label", "n": "at", "size": "score", "host": "pick"})
    got = quality.score(odd.unionByName(odd), model).groupBy("doc_id").agg(F.countDistinct("score").alias("n"), F.count("*").alias("rows")).collect()
    assert all(r["n"] == 1 and r["rows"] == 2 for r in got)
    labels = spark.createDataFrame([(i, i % 2) for i in range(12)], "doc_id long, label int")
    assert len(quality.fit(odd, labels).labels) == 12


def test_junk_goes_and_clean_texts_stay(spark, docs, rows, model):
    bad = frame(spark, [(500 + i, junk(i) + "x", None, None) for i in range(6)])
    kept = quality.keep_good(docs.unionByName(bad), model)
    assert kept.columns == docs.columns
    ids = {r["doc_id"] for r in kept.collect()}
    assert not ids & set(range(500, 506)) and set(range(12)) <= ids


def test_without_labels_and_without_documents(spark, docs, no_docs, model):
    nothing = quality.fit(docs, spark.createDataFrame([], "doc_id long, label int"))
    assert {r["score"] for r in quality.score(docs, nothing).collect()} == {0.5}
    assert quality.score(no_docs, model).count() == 0
    assert quality.score(docs.where("text IS NULL OR text = ''"), model).distinct().count() == 2


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_held_out_accuracy(spark):
    found = q_quality.query(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out").collect()
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in found)
    assert np.mean([r["predicted"] == r["quality"] for r in found]) > 0.97
    assert q_quality.query(spark, SF).where(F.col("score").isNull() | (F.col("score") < 0) | (F.col("score") > 1)).count() == 0
