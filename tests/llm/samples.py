"""Documents with everything that is awkward, and their plain Python counterparts."""

import random
import re

#: Extra columns whose names the operators use themselves.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, doc long, key string, part int, size string, n int, row string, named string, host string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sentence(rng, n):
    return " ".join("".join(rng.choice(["ba", "de", "ki", "lo", "mu", "é", "ß"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def corpus():
    """(doc_id, text, lang, source): copies, near copies, shared passages, nulls, empty and long texts."""
    rng = random.Random(7)
    passage = sentence(rng, 70)
    base = [sentence(rng, rng.randint(60, 160)) for _ in range(12)]
    rows = [(i, t, ["en", "de", None][i % 3], ["a", "b", None][i % 3]) for i, t in enumerate(base)]
    rows += [(20, base[0], "en", "a"), (21, base[0], "en", "b"), (22, base[1] + " extra words here", "de", "a")]
    near = base[2].split()
    near[5] = "changed"
    rows += [(23, " ".join(near), None, "b"), (24, "start " + passage + " end", "en", "a"), (25, sentence(rng, 9) + "\n" + passage + "\t" + sentence(rng, 9), "en", None)]
    rows += [(26, passage, "de", "b"), (27, None, "en", "a"), (28, "", None, None), (29, " \n\t ", "en", "a"), (30, "one", "en", "b"), (31, "One", "en", "b")]
    rows += [(32, "word " * 80, "en", "a"), (33, sentence(rng, 9000) + " " + passage, "en", "a"), (34, "### $$$ " * 60 + sentence(rng, 60), "en", "a")]
    rows += [(35, "line one\nline two\nline one\n" + sentence(rng, 60), "de", "a"), (36, "a b a b a b c", "de", "a"), (37, " no break " * 40, "de", "a")]
    return rows


def frame(spark, rows):
    full = [(i, t, lang, source, None, 1, "k", 2, "s", 3, "r", "x", "h") for i, t, lang, source in rows]
    return spark.createDataFrame(full, SCHEMA)


