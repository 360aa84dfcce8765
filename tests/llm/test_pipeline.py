"""The corpus pipeline, stage by stage, and the queries' SQL."""

import math
import os
import random

import duckdb
import public_tokenizers
import pytest
from samples import WORD, frame, sentence
from test_near import plain
from test_packing import check

corpus_pipeline = pytest.importorskip("corpus_pipeline")
from provweave.llm import entry, packing  # noqa: E402

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def kept(spark):
    """What each stage returns."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF).cache()
        out.append((name, docs))
    return out


def as_rows(df):
    return [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in df.collect()]


def test_columns(spark, kept):
    columns = spark.read.parquet(f"{SF}/documents.parquet").columns
    assert all(df.columns == columns for _, df in kept[:-1])


def test_good_documents_stay(spark, kept):
    ids = {r["doc_id"] for r in kept[0][1].collect()}
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    good = [r["doc_id"] in ids for r in labels if r["quality"] == 1]
    bad = [r["doc_id"] in ids for r in labels if r["quality"] == 0]
    assert sum(good) >= 0.97 * len(good) and sum(bad) <= 0.5 * len(bad)


def test_lines_and_near_duplicates(kept):
    assert len(as_rows(kept[1][1])) == len(as_rows(kept[0][1]))
    want = {i for i, _, _, k in plain(as_rows(kept[1][1]), 5, 80) if k}
    assert {r[0] for r in as_rows(kept[2][1])} == want


def test_copies_are_left_to_near_dedup(spark):
    rng = random.Random(3)
    text = lambda: [sentence(rng, 30) for _ in range(4)]
    common, exact, near = sentence(rng, 8), text(), text()
    rows = [(i, "\n".join(text() + [common] * (i % 5 == 0)), "en", "s") for i in range(200)]
    rows += [(1000 + i, "\n".join(exact), "en", "s") for i in range(16)] + [(None, "\n".join(exact[::-1]), "en", "s") for _ in range(16)]
    for i in range(16):
        changed = [x.split() for x in near]
        changed[i % 4][5 + i] = f"changed{i}"
        rows.append((2000 + i, "\n".join(" ".join(x) for x in changed), "en", "s"))
    clean = corpus_pipeline.dedup_lines(spark, frame(spark, rows), SF).cache()
    assert sorted(map(repr, as_rows(clean))) == sorted(repr((i, t.removesuffix("\n" + common), *more)) for i, t, *more in rows)
    left = {r[0]: r[1] for r in as_rows(corpus_pipeline.dedup_documents(spark, clean, SF))}
    assert set(left) == {*range(200), 1000, 2000, None}
    assert left[1000] == "\n".join(exact) and left[2000] == rows[-16][1]


def test_mixture_and_packing(kept):
    size = lambda rows: sum(len(WORD.findall(t or "")) for _, t, *_ in rows)
    before, mixed = as_rows(kept[2][1]), as_rows(kept[3][1])
    assert math.isclose(size(mixed), 1.5 * size(before), rel_tol=0.1)
    check(packing.pack_documents(kept[3][1], public_tokenizers.path("word_bpe_49k.json")).collect(), mixed, 4096)
    packed = kept[4][1]
    assert packed.count() >= len(mixed)


def test_stages_on_odd_documents(spark, rows):
    """Nulls, empty and long texts, repeated rows and ids, clashing columns, one stage after another."""
    odd = [*rows, *rows[:3], (20, "another text of the same id " * 20, "en", "a"), (None, rows[0][1], "en", "a"), (None, None, None, None)]
    docs = start = frame(spark, odd)
    for name, stage in corpus_pipeline.STAGES[1:-1]:
        before, docs = docs, stage(spark, docs, SF).cache()
        assert docs.columns == start.columns, name
        if name == "line_dedup":
            assert docs.count() == len(odd) and {r["doc_id"] for r in docs.where("text IS NULL").collect()} == {27, None}
        if name == "near_dedup":
            ids = [r["doc_id"] for r in docs.collect()]
            assert ids.count(None) == 2 and ids.count(0) == 2 and 21 not in ids and len(ids) < len(odd)
        if name == "mixing":
            assert {r["doc_id"] for r in docs.collect()} <= {r["doc_id"] for r in before.collect()} and docs.count() > 0
    packed = corpus_pipeline.pack(spark, docs, SF)
    assert packed.selectExpr("sum(length)").first()[0] == packed.where("start = 0").selectExpr("sum(doc_tokens)").first()[0]
    scored = corpus_pipeline.classify(spark, start, SF)
    assert scored.columns == start.columns and scored.count() <= len(odd)


def test_stages_on_nothing(spark, no_docs):
    docs = no_docs
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_queries_against_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    got, want = entry.queries()[name](spark, SF).toPandas(), con.sql(entry.oracle_sql()[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = lambda df: sorted(map(repr, df[columns].astype(object).where(df[columns].notna(), None).itertuples(index=False, name=None)))
    assert rows(got) == rows(want)
