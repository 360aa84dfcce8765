"""op4: quality rules over all documents."""

from pyspark.sql import DataFrame, SparkSession

from . import rules

NAME = "op4_quality_rules"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = rules.judge(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_BOUNDS = """
  SELECT {keys} rule, CAST(any_value(total) AS DOUBLE) AS n,
         q50 + 8 * greatest(CAST(q75 - q50 AS DOUBLE), (q90 - q50) / 2.0, CASE rule WHEN 'dup_lines' THEN 50 WHEN 'repeats' THEN 20 WHEN 'word_length' THEN 5 ELSE 1 END) AS bound
  FROM (SELECT {keys} rule, any_value(total) AS total, min(CASE WHEN upto * 100 >= total * 50 THEN low END) AS q50,
               min(CASE WHEN upto * 100 >= total * 75 THEN low END) AS q75, min(CASE WHEN upto * 100 >= total * 90 THEN low END) AS q90
        FROM (SELECT *, sum(n) OVER (PARTITION BY {keys} rule) AS total,
                     sum(n) OVER (PARTITION BY {keys} rule ORDER BY low) AS upto FROM {sketch}) GROUP BY {keys} rule)
  GROUP BY {keys} rule, q50, q75, q90"""

ORACLE_SQL = rf"""
WITH parsed AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l,
         row_number() OVER () AS r
  FROM documents),
windows AS (
  SELECT r, i, [w[i], w[i + 1], w[i + 2]] AS t FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM parsed)),
repeated AS (
  SELECT r, count(DISTINCT i + k) AS n
  FROM (SELECT r, i, unnest([0, 1, 2]) AS k
        FROM (SELECT r, i, count(*) OVER (PARTITION BY r, t) AS times FROM windows) WHERE times > 1)
  GROUP BY r),
counted AS (
  SELECT doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words, CAST(len(l) AS BIGINT) AS n_lines,
         CAST(length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS BIGINT) AS n_capitals
  FROM parsed LEFT JOIN repeated USING (r)),
rated AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
         n_symbols * 1000 // greatest(word_chars, 1) AS symbols, n_dup_lines * 1000 // greatest(n_lines, 1) AS dup_lines,
         n_repeat_words * 1000 // greatest(n_words, 1) AS repeats, n_capitals * 1000 // greatest(word_chars, 1) AS capitals, word_chars * 100 // greatest(n_words, 1) AS word_length
  FROM counted),
long AS (
  SELECT lang, source, rule, (rate >> greatest(length(bin(rate)) - 6, 0)) << greatest(length(bin(rate)) - 6, 0) AS low
  FROM (SELECT lang, source, unnest(['symbols', 'dup_lines', 'repeats', 'capitals', 'word_length']) AS rule,
               unnest([symbols, dup_lines, repeats, capitals, word_length]) AS rate FROM rated WHERE NOT base_failed)),
own AS (SELECT lang, source, rule, low, count(*) AS n FROM long GROUP BY ALL),
by_lang AS (SELECT lang, rule, low, sum(n) AS n FROM own GROUP BY ALL),
overall AS (SELECT rule, low, sum(n) AS n FROM by_lang GROUP BY ALL),
a AS ({_BOUNDS.format(keys='lang, source,', sketch='own')}),
b AS ({_BOUNDS.format(keys='lang,', sketch='by_lang')}),
c AS ({_BOUNDS.format(keys='', sketch='overall')}),
bounds AS (
  SELECT lang, source, rule, least((n * bound + 100 * b) / (n + 100), 2.0 * b) AS most
  FROM (SELECT a.lang, a.source, a.rule, a.n, a.bound, least((b.n * b.bound + 100 * c.bound) / (b.n + 100), 2.0 * c.bound) AS b
        FROM a JOIN b ON a.lang IS NOT DISTINCT FROM b.lang AND a.rule = b.rule JOIN c ON c.rule = a.rule)),
wide AS (
  SELECT lang, source, max(most) FILTER (rule = 'symbols') AS s, max(most) FILTER (rule = 'dup_lines') AS d,
         max(most) FILTER (rule = 'repeats') AS p, max(most) FILTER (rule = 'capitals') AS k, max(most) FILTER (rule = 'word_length') AS l
  FROM bounds GROUP BY ALL)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT (symbols > s OR dup_lines > d OR repeats > p OR capitals > k OR word_length > l) AS kept
FROM rated LEFT JOIN wide ON wide.lang IS NOT DISTINCT FROM rated.lang AND wide.source IS NOT DISTINCT FROM rated.source
"""
