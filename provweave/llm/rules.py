"""Quality rules with adaptive thresholds from mergeable sketches.

Signals of whole texts are counted once per document.  Each signal is an integer rate,
and a sketch is a log-linear histogram of it: rates up to 32 have a bucket each, larger
ones share a bucket with those that agree in their six leading bits, so a quantile read
from it is off by at most 1/32.  Two sketches merge by adding counts; the sketches per
language and source are merged into those per language and of all documents.

A sketch's own bound for a rule is ``q50 + spread * max(q75 - q50, (q90 - q50) / 2, step)``: a multiple of
the group's own spread above its median, with a small ``step`` for rates that are zero nearly
everywhere.  The bound of a group of n documents is the mean of its own, weighed by n, and its
parent's, weighed by ``prior``, and at most twice the parent's: a small group leans on its
language, a language on all documents, and a group that is mostly junk does not set its own standard.
A document fails a rule when its rate lies above the bound of its language and source.

Defined results: null and empty texts have zero counts and fail the base rules; a null
language or source is a group of its own; equal rows are judged alike; an empty table
gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from . import blocks, scratch

WHITE, SYMBOLS, CAPITALS = b" \t\n\x0b\x0c\r", b"#*$%&|<>", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals")
#: Rule: the integer rate, and the least spread that counts, in the same unit.
RULES: dict[str, tuple[str, int]] = {
    "symbols": ("n_symbols * 1000 div greatest(word_chars, 1)", 1),
    "dup_lines": ("n_dup_lines * 1000 div greatest(n_lines, 1)", 50),
    "repeats": ("n_repeat_words * 1000 div greatest(n_words, 1)", 20),
    "capitals": ("n_capitals * 1000 div greatest(word_chars, 1)", 1),
    "word_length": ("word_chars * 100 div greatest(n_words, 1)", 5),
}


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window found twice or more in the text, the first included."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    times, end, n = Counter(windows), 0, 0
    for i, window in enumerate(windows):
        if times[window] > 1:
            n += i + 3 - max(i, end)
            end = i + 3
    return n


def count_text(text: str | None) -> tuple[int, ...]:
    """The values of COUNTS for one text."""
    raw = (text or "").encode()
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    blanks = len(raw) - len(raw.translate(None, WHITE))
    return (len(words), len(text or "") - blanks, len(raw) - len(raw.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words), len(lines), len(raw) - len(raw.translate(None, CAPITALS)))


def signals(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and COUNTS of every document."""
    own = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [count_text(x.as_py()) for x in batch.column("text")]
            columns = [pa.array(x, pa.int64()) for x in zip(*rows)] if rows else [pa.array([], pa.int64()) for _ in COUNTS]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "lang", "source")), *columns], ["doc_id", "lang", "source", *COUNTS])

    schema = StructType([own.schema["doc_id"], StructField("lang", StringType()), StructField("source", StringType()), *(StructField(c, LongType()) for c in COUNTS)])
    return own.mapInArrow(blocks.frugal(count), schema)


def thresholds(judged: DataFrame, spread: int, prior: int) -> DataFrame:
    """lang, source and the bound of each rule, from documents with lang, source and rates."""
    parts = ", ".join(f"'{r}', {r}" for r in RULES)
    long = judged.select("lang", "source", F.expr(f"stack({len(RULES)}, {parts}) AS (rule, rate)"))
    more = "greatest(length(bin(rate)) - 6, 0)"
    long = long.withColumn("low", F.expr(f"shiftleft(rate >> {more}, {more})"))
    own = scratch.table(long.groupBy("lang", "source", "rule", "low").agg(F.count("*").alias("n")), "sketches")
    by_lang = own.groupBy("lang", "rule", "low").agg(F.sum("n").alias("n"))
    overall = by_lang.groupBy("rule", "low").agg(F.sum("n").alias("n"))
    step = F.create_map(*[F.lit(x) for r, (_, s) in RULES.items() for x in (r, s)])[F.col("rule")]

    def bounds(sketch: DataFrame, keys: list[str], name: str) -> DataFrame:
        """keys, rule, number of documents and the sketch's own bound."""
        group = Window.partitionBy(*keys, "rule")
        ranks = sketch.withColumn("total", F.sum("n").over(group)).withColumn("at", F.sum("n").over(group.orderBy("low")))
        quantile = lambda q: F.min(F.when(F.col("at") * 100 >= F.col("total") * q, F.col("low"))).alias(f"q{q}")
        out = ranks.groupBy(*keys, "rule").agg(F.first("total").cast("double").alias(f"n_{name}"), quantile(50), quantile(75), quantile(90))
        return out.select(*keys, "rule", f"n_{name}", (F.col("q50") + spread * F.greatest((F.col("q75") - F.col("q50")).cast("double"), (F.col("q90") - F.col("q50")) / 2.0, step.cast("double"))).alias(name))

    a, b, c = bounds(own, ["lang", "source"], "a").alias("a"), bounds(by_lang, ["lang"], "b").alias("b"), bounds(overall, [], "c").alias("c")
    rows = a.join(b, F.col("a.lang").eqNullSafe(F.col("b.lang")) & (F.col("a.rule") == F.col("b.rule"))).join(c, F.col("a.rule") == F.col("c.rule"))
    leant = lambda name, parent: F.least((F.col(f"n_{name}") * F.col(name) + prior * F.col(parent)) / (F.col(f"n_{name}") + prior), 2.0 * F.col(parent))
    rows = rows.select("a.lang", "a.source", "a.rule", "n_a", "a", "c", leant("b", "c").alias("b"))
    rows = rows.select("lang", "source", "rule", leant("a", "b").alias("most"))
    return rows.groupBy("lang", "source").agg(*[F.max(F.when(F.col("rule") == r, F.col("most"))).alias(f"most_{r}") for r in RULES])


def judge(docs: DataFrame, spread: int = 8, prior: int = 100, min_words: int = 50) -> DataFrame:
    """Signals of every document with base_failed, kept, and the bound of each rule in its group."""
    rates = [F.expr(e).alias(r) for r, (e, _) in RULES.items()]
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    counted = scratch.table(signals(docs), "signals").select("*", *rates, failed.alias("base_failed"))
    most = thresholds(counted.where(~F.col("base_failed")), spread, prior).alias("m")
    rows = counted.alias("d").join(most, F.col("d.lang").eqNullSafe(F.col("m.lang")) & F.col("d.source").eqNullSafe(F.col("m.source")), "left").drop(F.col("m.lang")).drop(F.col("m.source"))
    above = F.lit(False)
    for r in RULES:
        above = above | F.coalesce(F.col(r) > F.col(f"most_{r}"), F.lit(False))
    return rows.withColumn("kept", ~F.col("base_failed") & ~above)
