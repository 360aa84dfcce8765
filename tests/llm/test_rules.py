"""Quality rules against plain counts."""

import random
import re
from collections import Counter

from samples import WORD, frame

from provweave.llm import rules


def plain(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(3)}
    return {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered)}


def test_counts_and_verdicts(docs, rows):
    got = {r["doc_id"]: r.asDict() for r in rules.judge(docs).collect()}
    assert len(got) == len(rows)
    for i, t, *_ in rows:
        want = plain(t)
        assert {k: got[i][k] for k in want} == want, i
        failed = want["n_words"] < 50 or 100 * want["n_repeat_words"] > 50 * want["n_words"]
        assert got[i]["base_failed"] == failed and not (failed and got[i]["kept"])
    assert all(got[i]["kept"] for i in (*range(12), 20, 21, 22, 23)) and not got[34]["kept"]


def test_thresholds_follow_the_group_and_merge(spark):
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(60)), "en", "big") for i in range(30)]
    rows += [(100 + i, " ".join(f"v{i}y{k}" for k in range(60)) + " #" * 20, "en", "tiny") for i in range(2)]
    judged = {r["doc_id"]: r for r in rules.judge(frame(spark, rows), prior=20).collect()}
    assert judged[0]["kept"] and not judged[100]["kept"]  # a tiny source leans on its language
    own = {r["doc_id"]: r for r in rules.judge(frame(spark, rows), prior=0).collect()}
    assert own[0]["most_symbols"] == 8 and own[100]["most_symbols"] == 16  # its own bound, but at most twice the language's


#: What a document of a group of plain ones must do to break one rule, and no other.
OUTLIERS = {
    "symbols": lambda i: " ".join(f"{'#' * (k % 2)}wo{i}x{k}" for k in range(90)),
    "dup_lines": lambda i: "\n".join([f"li{i}e wi{i}th" for _ in range(40)] + [f"ow{i}n{k} te{i}xt{k}" for k in range(40)]),
    "repeats": lambda i: " ".join([f"w{i}x{k}" for k in range(90)] + [f"w{i}x{k}" for k in range(15)]),
    "capitals": lambda i: " ".join(f"W{i}x{k}" for k in range(90)),
    "word_length": lambda i: " ".join(f"longer{i}than{k}others" for k in range(90)),
}


def test_each_rule_rejects_outliers_of_a_group(spark):
    rng = random.Random(4)
    plain_text = lambda i: "\n".join(" ".join(f"w{i}x{k}{'y' * rng.randint(0, 2)}" for k in range(20 * j, 20 * j + 20)) for j in range(5))
    rows = [(i, plain_text(i), "en", "s") for i in range(100)] + [(200 + n, f(n), "en", "s") for n, f in enumerate(OUTLIERS.values())]
    judged = {r["doc_id"]: r.asDict() for r in rules.judge(frame(spark, rows)).collect()}
    assert all(judged[i]["kept"] for i in range(100))
    for n, rule in enumerate(OUTLIERS):
        broken = [r for r in rules.RULES if judged[200 + n][r] > judged[200 + n][f"most_{r}"]]
        assert rule in broken and not judged[200 + n]["base_failed"] and not judged[200 + n]["kept"], (rule, broken)


def test_sources_decide_in_the_smallest_tables(spark):
    """Bounds differ between the sources of a language, also where no source is large."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    most = rules.judge(docs).where("not base_failed").select("lang", "source", "most_word_length").distinct().collect()
    assert len({r["most_word_length"] for r in most if r["lang"] == "en"}) > 3


def test_repeated_rows_and_clashing_names(spark, rows):
    twice = {}
    for r in rules.judge(frame(spark, rows + rows).withColumnsRenamed({"n": "rule", "size": "rate", "host": "kept_", "named": "low"})).collect():
        twice.setdefault(r["doc_id"], set()).add((r["kept"], r["n_words"]))
    assert all(len(v) == 1 for v in twice.values()) and len(twice) == len(rows)


def test_nothing(no_docs):
    assert rules.judge(no_docs).count() == 0
