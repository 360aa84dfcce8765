"""Words and texts as JVM-side column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What separates words: space and U+0009..U+000D, nothing else.
BLANK = "[\\x20\\x09-\\x0D]"
BLANKS = " \t\n\x0b\x0c\r"


def n_words(text: Column) -> Column:
    """Words of a text as a long; 0 for null, empty and blank texts."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(bare == "", F.lit(0)).otherwise(F.size(F.split(bare, f"{BLANK}+"))).cast("long")


def words(text: Column) -> Column:
    """The words of a text in order; an empty array for null, empty and blank texts."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, f"{BLANK}+"))
