"""Personal data against Python's regular expressions and plain counts."""

import random
import re
import time
from collections import Counter

import pytest
from samples import WORD, frame
from pyspark.sql import functions as F

from provweave.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(int(d) if k % 2 == 0 else sum(divmod(2 * int(d), 10)) for k, d in enumerate(reversed(digits))) % 10 == 0


def plain(text):
    text, out = text or "", []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 13 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}
            if good[kind]:
                out.append((kind, m.start(), m.end()))
    return out


NAMES = (*pii.KINDS, *pii.ADDED)


def spans(column):
    return [(NAMES[s["k"]], s["start"], s["end"]) for s in column]


TEXTS = [
    "mail a.b+c@ex-ample.co.uk, or x@y, x@y.z_q@r.st and é😀 me@host.org.", "a@b.c@d.e f@g..h i@-.-", "10.0.0.1 and 256.1.1.1 and 1.2.3.4.5.6.7.8 and 0255.001.0.0.",
    "4111 1111 1111 1111, 4111-1111-1111-1112, 4111  1111 1111 1111, 12345678901234567890123", "+1 (415) 555-2671 +49 30 123 +5", "tel+1234567890x\n+123456789\n0", "", None, "0" * 3000, "a" * 5000 + "@", "1." * 2000, "@." * 1000,
    "++1 2345678901 +1+22222222222", "9" * 16 + " 5500-0000-0000-0004",
]


@pytest.mark.parametrize("size", [1, 3])
def test_base_spans(spark, docs, rows, size):
    own = [(i, t, None, None) for i, t in enumerate(TEXTS * size)]
    got = {r["doc_id"]: spans(r["found"]) for r in pii.find(frame(spark, own)).collect()}
    for i, t, *_ in own:
        assert got[i] == plain(t), t
    assert {r["doc_id"]: spans(r["found"]) for r in pii.find(docs).collect()} == {i: plain(t) for i, t, *_ in rows}


def test_cards_in_groups_of_one_and_two_digits(spark):
    cards = ["41 11 11 11 11 11 11 11", "4-1-1-1-1-1-1-1-1-1-1-1-1-1-1-1-7 1", "4 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1", "41-11 11-11 11-11 11-11", "0-0-0-0-0-0-0-0-0-0-0-0-0", "4-2-2-2-2-2-2-2-2-2-2-2-2"]
    wrong = ["41 11 11 11 11 11 11 12", "0 0 0 0 0 0 0 0 0 0 0 0", "41  11 11 11 11 11 11 11", "4\t1-1-1-1-1-1-1-1-1-1-1-1-1-1-1"]
    own = [(i, f"paid by {c}, thanks", None, None) for i, c in enumerate(cards + wrong)]
    got = {r["doc_id"]: spans(r["found"]) for r in pii.find(frame(spark, own)).collect()}
    assert got == {i: plain(t) for i, t, *_ in own}
    assert sum(bool(got[i]) for i in range(len(cards))) >= 4 and not any(got[len(cards) + i] for i in range(3))


TERM = re.compile(r"[^\W\d_](?:[^\W\d_]|['-])*")


def term(word):
    """The letters of a word without marks around them, if that is all there is."""
    letters = [i for i, c in enumerate(word) if c.isalpha()]
    if not letters:
        return "", 0
    m = TERM.match(word, letters[0])
    return (m[0], m.start()) if not any(c.isalpha() for c in word[m.end() :]) else ("", 0)


def split(text):
    return re.split(r"[\x20\x09-\x0D]", text)


def disclosed(rows, support=2, window=80):
    """Added spans of each document by plain counting."""
    docs = [(i, t or "") for i, t, *_ in rows]
    found = []
    for _, t in docs:
        own = [(k, a, b) for k, a, b in plain(t)]
        own += [("secret", m.start(), m.end()) for m in re.finditer("[A-Za-z0-9]{20,}", t) if sum(c.isdigit() for c in m[0]) >= 4 and sum(c.isalpha() for c in m[0]) >= 4]
        found.append(own)
    n_t, n_e, n_te, holds = Counter(), Counter(), Counter(), []
    for (_, t), own in zip(docs, found):
        n_t.update({w for w in (term(x)[0] for x in split(t)) if len(w) >= 3})
        met, classes = set(), set()
        for kind in [*PATTERNS, "secret"]:
            pattern = re.compile(PATTERNS.get(kind, "[A-Za-z0-9]{20,}"))
            matches = [m.span() for m in pattern.finditer(t)]
            for j, (a, b) in enumerate(matches):
                if (kind, a, b) not in own:
                    continue
                low, high = (matches[j - 1][1] if j else 0), (matches[j + 1][0] if j + 1 < len(matches) else len(t))
                before, after = split(t[low:a][-window:]), split(t[b:high][:window])
                words = (before[1:] if a - low >= window else before) + (after[:-1] if high - b >= window else after)
                value, digits = t[a:b], re.sub("[^0-9]", "", t[a:b])
                wider = {"email": "email@" + value.rpartition("@")[2].lower(), "ip": "ip:" + ".".join(value.split(".")[:2]), "card": "card:" + digits[:6], "phone": "phone:" + digits[:4], "secret": None}[kind]
                for level, entity in ((1, f"{kind}={value.lower()}"), (2, wider), (3, kind)):
                    if entity:
                        classes.add(entity)
                        met.update((w, level, entity) for w in (term(x)[0] for x in words) if len(w) >= 3)
        n_e.update(classes), n_te.update(met), holds.append(classes)
    told = {(w, level, e): n for (w, level, e), n in n_te.items() if n >= support and n_t[w] and (n / n_t[w]) ** 10 * len(docs) >= n_e[e] * (1 - 1e-12)}
    everywhere = {w for (w, level, e), n in told.items() if level == 1 and 2 * n >= n_t[w]}
    out = []
    for (i, t), own, classes in zip(docs, found, holds):
        marked, at = [], 0
        for x in split(t):
            w, lead = term(x)
            if w in everywhere or any(v == w and e in classes for v, _, e in told):
                marked.append(("term", at + lead, at + lead + len(w)))
            at += len(x) + 1
        out.append((i, [s for s in own if s[0] == "secret"] + marked))
    return out


def by_doc(pairs):
    out = {}
    for i, s in pairs:
        out.setdefault(i, []).append(s)
    return {i: sorted(map(tuple, s)) for i, s in out.items()}


ROWS = [(i, f"Zorba wrote, once, to z@x.org\nplain line {i}", None, None) for i in range(4)] + [(10 + i, f"wrote to o{i}@x.org about plain things", None, None) for i in range(30)]
ROWS += [(50, "(Zorba) is not named here beside anything", None, None), (51, "key = a1b2c3d4e5f6g7h8i9j0k, and aaaaaaaaaaaaaaaaaaaaaaaa", None, None), (52, "Konto: 4111 1111 1111 1111", None, None), (53, "Konto\n4111-1111-1111-1112 Konto 4111 1111 1111 1111", None, None)]
ROWS += [(100 + i, f"they wrote about plain things, line {i}", None, None) for i in range(70)]


def test_terms_that_disclose(spark):
    found = {r["doc_id"]: r for r in pii.find(frame(spark, ROWS)).collect()}
    assert {i: spans(r["added"]) for i, r in found.items()} == dict(disclosed(ROWS))
    assert spans(found[0]["added"])[0] == ("term", 0, 5) and not found[10]["added"]  # "wrote" and "plain" tell nothing
    assert spans(found[50]["added"]) == [("term", 1, 6)]  # Zorba discloses the address wherever the name stands
    assert spans(found[51]["added"]) == [("secret", 6, 27)]
    assert [s[0] for s in spans(found[53]["added"])] == ["term", "term"]  # on the lines around the number too
    clean = {r["doc_id"]: r["text"] for r in pii.redact(pii.find(frame(spark, ROWS))).collect()}
    assert clean[50] == "([TERM]) is not named here beside anything" and clean[51].startswith("key = [SECRET], and a") and clean[52] == "[TERM]: [CARD]"


@pytest.mark.parametrize("seed", [1, 2])
def test_disclosure_against_plain_counting(spark, docs, rows, seed):
    rng = random.Random(seed)
    words = ["alpha", "Beta", "gamma-ray", "d'Or", "né", "x", "42", "“quoted”", "tail,", "(paren)", "naïve", "mixed1"]
    things = ["a@b.cc", "c@b.cc", "9.8.7.6", "9.8.1.2", "+12 345 678 90", "4111 1111 1111 1111", "f00dbeef12345678cafe"]
    texts = ["".join(rng.choice([*words, *words, *things]) + rng.choice([" ", " ", "\n", "\t", "  "]) for _ in range(rng.randint(0, 30))) for _ in range(60)]
    own = [(i, t, None, None) for i, t in enumerate(texts)]
    assert by_doc((r["doc_id"], spans(r["added"])) for r in pii.find(frame(spark, own)).collect()) == by_doc(disclosed(own))
    assert by_doc((r["doc_id"], spans(r["added"])) for r in pii.find(docs).collect()) == by_doc(disclosed(rows))


def test_the_method_adds_spans_to_the_smallest_tables(spark):
    found = pii.find(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    kinds = {r["kind"]: r["n"] for r in found.select(F.explode("added").alias("x")).groupBy(pii.name(F.col("x.k")).alias("kind")).agg(F.count("*").alias("n")).collect()}
    assert kinds["term"] > 20 and kinds["secret"] > 5


def test_long_texts_take_linear_time(spark):
    many = "\n".join(f"Reach nome{i} at u{i}@host.example soon" for i in range(20_000))
    own = [(1, many, None, None), (2, "word " * 100_000 + "a@b.cc", None, None), (3, "1.2.3.4 " * 30_000, None, None)]
    began = time.time()
    got = {r["doc_id"]: r["n"] for r in pii.find(frame(spark, own)).select("doc_id", F.size("found").alias("n")).collect()}
    assert got == {1: 20_000, 2: 1, 3: 30_000} and time.time() - began < 60


def test_equal_ids_and_nothing(spark, no_docs):
    rows = [(1, "a@b.cc", None, None), (1, "none", None, None), (None, "c@d.ee", None, None), (None, "c@d.ee", None, None)]
    found = pii.find(frame(spark, rows)).select("text", F.size("found").alias("n")).collect()
    assert sorted((r["text"], r["n"]) for r in found) == [("a@b.cc", 1), ("c@d.ee", 1), ("c@d.ee", 1), ("none", 0)]
    assert pii.find(no_docs).count() == 0 and pii.redact(pii.find(no_docs)).count() == 0
