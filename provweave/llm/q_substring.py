"""op5: remove repeated passages of 50 words from all documents."""

from pyspark.sql import DataFrame, SparkSession

from . import substring

NAME = "op5_substring_dedup"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep_text=False)


ORACLE_SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (
  SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM words)),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY h) AS first FROM windows) WHERE doc_id > first),
gone AS (SELECT DISTINCT doc_id, i + k AS i FROM later, range(50) r(k)),
each AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM words),
kept AS (
  SELECT e.doc_id, string_agg(word, ' ' ORDER BY e.i) AS left_over, count(*) AS n
  FROM each e ANTI JOIN gone g ON e.doc_id = g.doc_id AND e.i = g.i GROUP BY e.doc_id)
SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(left_over, '')) AS kept_sha256
FROM words w LEFT JOIN kept USING (doc_id)
"""
