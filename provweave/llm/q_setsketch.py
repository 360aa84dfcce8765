"""op9: near-duplicates among all documents."""

from pyspark.sql import DataFrame, SparkSession

from . import setsketch

NAME = "op9_setsketch_near_dedup"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setsketch.near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), size=2)


ORACLE_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, s
  FROM (SELECT doc_id, CASE WHEN len(w) < 2 THEN [w[1]] ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END AS l
        FROM words WHERE len(w) > 0), unnest(l) t(s)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
-- of n elements in a fixed order, rarest first, similar sets share one of the first n - ceil(0.8 n) + 1
ranked AS (
  SELECT doc_id, s, n, row_number() OVER (PARTITION BY doc_id ORDER BY f, s) AS r
  FROM shingles JOIN sizes USING (doc_id) JOIN (SELECT s, count(*) AS f FROM shingles GROUP BY s) USING (s)),
heads AS (SELECT * FROM ranked WHERE r <= n - (80 * n + 99) // 100 + 1),
pairs AS (
  SELECT DISTINCT a.doc_id AS a, b.doc_id AS b, a.n AS n_a, b.n AS n_b
  FROM heads a JOIN heads b ON a.s = b.s AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)),
links AS (
  SELECT a, b FROM pairs JOIN shingles x ON x.doc_id = a JOIN shingles y ON y.doc_id = b AND y.s = x.s
  GROUP BY a, b, n_a, n_b HAVING 100 * count(*) >= 80 * (n_a + n_b - count(*))),
ends AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS id, doc_id AS least FROM documents UNION SELECT b.b, r.least FROM reach r JOIN ends b ON b.a = r.id WHERE r.least < b.b)
SELECT w.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, component_id = w.doc_id AS kept
FROM words w LEFT JOIN sizes USING (doc_id) JOIN (SELECT id AS doc_id, min(least) AS component_id FROM reach GROUP BY id) USING (doc_id)
"""
