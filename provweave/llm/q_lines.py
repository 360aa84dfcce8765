"""op8: drop the boilerplate lines of all pages."""

from pyspark.sql import DataFrame, SparkSession

from . import lines

NAME = "op8_line_dedup"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.clean_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))


ORACLE_SQL = rf"""
WITH bare AS (
  SELECT page_id, row_number() OVER () AS r, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#@]*@)?([^/?#:]+)', 2)) AS h,
         regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''),
           '(?is)<(?:script|style)[^>]*(?:>.*?(?:</(?:script|style)>|\z)|\z)', ' ', 'g'), '(?s)<!--.*?(?:-->|\z)', ' ', 'g'),
           '[\x20\x09-\x0D]+', ' ', 'g'), '(?i)</?({lines.BLOCKS})(>|[ /][^<>]*>)', chr(10), 'g'), '<[^<>]*>', '', 'g') AS text
  FROM pages),
parsed AS (
  SELECT page_id, r, CASE WHEN h != '' THEN h END AS host,
         list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, ' +', ' ', 'g'), ' ')), lambda x: x != '') AS lines
  FROM bare),
each AS (SELECT r, page_id, host, unnest(lines) AS line, unnest(range(len(lines))) AS i FROM parsed),
counted AS (SELECT host, line, count(DISTINCT r) AS n FROM each WHERE host IS NOT NULL GROUP BY host, line),
dropped AS (
  SELECT c.host, line FROM counted c JOIN (SELECT host, count(*) AS pages FROM parsed GROUP BY host) p ON p.host = c.host
  WHERE n >= 3 AND n > 0.25 * pages),
kept AS (
  SELECT r, string_agg(e.line, chr(10) ORDER BY i) AS text, count(*) AS n
  FROM each e ANTI JOIN dropped d ON e.host = d.host AND e.line = d.line GROUP BY r)
SELECT page_id, host, CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - coalesce(n, 0) AS BIGINT) AS n_dropped,
       coalesce(text, '') AS text
FROM parsed LEFT JOIN kept USING (r)
"""
