"""Line dedup by site-relative frequency.

The pages of a host are its total; a line that stands in more than ``ratio`` of them, on
``least`` pages or more, is boilerplate of that host and dropped from its pages.  A page counts
once for a line.  Counts are per host and line hash and are combined before their shuffle, so
a hot host or line costs one row per task.  The frequencies of a host's lines add up to
the mean number of lines of its pages, so a host has at most that / ``ratio`` boilerplate
lines, and they fit one row.  The table of them is stored, so that its true size decides
whether it is broadcast; otherwise the join is by host, split where a host is hot.  Where groups
of copies are given, a group counts once for a line, so that what is copied whole is not
taken for boilerplate; pages, their total, are counted as they are.

Defined results: null and empty texts have no lines; rows with a null host are left as
they are; repeated rows count as pages of their own; an empty table gives an empty
result; further columns are kept by ``drop_boilerplate``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scratch
from . import text as t

#: Tags that end a line.
BLOCKS = "p|div|br|li|ul|ol|h[1-6]|tr|td|th|table|nav|footer|header|article|section|title|head|body|html|main|aside|form|blockquote|pre"


def html_lines(html: Column) -> Column:
    """Visible lines of a page: tags, scripts, styles and comments gone, blanks collapsed.

    What is opened and never closed, a script, a style or a comment, runs to the end of the page; a
    tag ends before the next ``<`` at the latest.  So no pattern looks at a byte more than a few times.
    """
    bare = F.regexp_replace(F.coalesce(html, F.lit("")), "(?is)<(?:script|style)[^>]*+(?:>.*?(?:</(?:script|style)>|\\z)|\\z)", " ")
    bare = F.regexp_replace(bare, "(?s)<!--.*?(?:-->|\\z)", " ")
    bare = F.regexp_replace(bare, f"{t.BLANK}+", " ")
    bare = F.regexp_replace(bare, f"(?i)</?({BLOCKS})(>|[ /][^<>]*+>)", "\n")
    bare = F.regexp_replace(bare, "<[^<>]*+>", "")
    return F.filter(F.transform(F.split(bare, "\n"), lambda x: F.btrim(F.regexp_replace(x, " +", " "))), lambda x: x != "")


def host(url: Column) -> Column:
    """Host name of a URL in lower case; null where there is none."""
    found = F.lower(F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#@]*@)?([^/?#:]+)", 2))
    return F.when(found != "", found)


def boilerplate(pages: DataFrame, ratio: float, least: int, copies: DataFrame | None = None) -> DataFrame:
    """(host, hashes): hashes of boilerplate lines of each host that has any.

    ``pages``: host, lines (array of strings), and doc_id if ``copies`` are given.
    ``copies``: doc_id, each once, and copy_of; pages of one host and copy_of count once for a line,
    and so do pages of equal lines whose doc_id has none.
    """
    own = pages.where(F.col("host").isNotNull())
    totals = own.groupBy("host").agg(F.count("*").alias("pages"))
    hashes = F.array_distinct(F.transform("lines", lambda x: F.xxhash64(x)))
    if copies is None:
        each = own.select("host", F.explode(hashes).alias("line"))
    else:
        each = own.select("host", "doc_id", hashes.alias("hashes")).join(copies, "doc_id", "left")
        alone = F.concat(F.lit("="), F.xxhash64("hashes").cast("string"))
        each = each.select("host", F.coalesce(F.col("copy_of").cast("string"), alone).alias("copy_of"), F.explode("hashes").alias("line")).distinct()
    found = each.groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    found = found.join(totals, "host").where(F.col("n") > F.lit(ratio) * F.col("pages"))
    return found.groupBy("host").agg(F.collect_list("line").alias("hashes"))


def without(lines: Column, hashes: Column) -> Column:
    """Lines whose hash is not among ``hashes`` (null: all lines)."""
    return F.when(hashes.isNull(), lines).otherwise(F.filter(lines, lambda x: ~F.array_contains(hashes, F.xxhash64(x))))


def drop_boilerplate(docs: DataFrame, site: str, ratio: float, least: int, copies: DataFrame | None = None) -> DataFrame:
    """``docs`` with boilerplate lines taken out of ``text``; ``site`` names the column of the host, ``copies`` as in ``boilerplate``."""
    own = docs.select(F.struct("*").alias("row"), F.col(site).cast("string").alias("host"), F.split(F.col("text"), "\n").alias("all"))
    lines = F.filter(F.coalesce("all", F.array().cast("array<string>")), lambda x: F.btrim(x, F.lit(t.BLANKS)) != "")
    ids = [] if copies is None else [F.col("row").getField("doc_id").alias("doc_id")]
    found = scratch.table(boilerplate(own.select("host", lines.alias("lines"), *ids), ratio, least, copies), "boilerplate")
    rows = own.join(found, "host", "left")
    text = F.when(F.col("hashes").isNull(), F.col("row").getField("text")).otherwise(F.array_join(without(F.col("all"), F.col("hashes")), "\n"))
    return rows.select(*[text.alias(c) if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns])


def clean_pages(pages: DataFrame, ratio: float = 0.25, least: int = 3) -> DataFrame:
    """page_id, host, n_lines, n_dropped, text of every page (page_id, url, html).

    Pages are parsed once; their lines are stored and read for the counts and for the result.
    """
    own = pages.select("page_id", host(F.col("url").cast("string")).alias("host"), html_lines(F.col("html").cast("string")).alias("lines"))
    own = scratch.table(own, "lines")
    rows = own.join(scratch.table(boilerplate(own.select("host", "lines"), ratio, least), "boilerplate"), "host", "left")
    rows = rows.withColumn("left", without(F.col("lines"), F.col("hashes")))
    return rows.select("page_id", "host", F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size("left")).cast("long").alias("n_dropped"), F.array_join("left", "\n").alias("text"))
