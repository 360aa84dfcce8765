"""op1: mix all documents."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import mixing

NAME = "op1_mix_sources"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized, cuts = mixing.plan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return mixing.taken(cuts, sized).select("doc_id", "size", "source_size", F.col("target"), "taken")


ORACLE_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5('17:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS key
  FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         [5.0, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3]::DOUBLE AS weight
  FROM sized GROUP BY source),
ranked AS (SELECT *, 2.0::DOUBLE * source_size AS cap, 2.0::DOUBLE * source_size / weight AS ratio FROM sources),
levels AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER ()
             - coalesce(sum(cap) OVER (ORDER BY ratio, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY ratio, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM ranked),
at_level AS (SELECT arg_min(level, ratio) AS at_level FROM levels WHERE level <= ratio),
goal AS (
  SELECT source, source_size, least(cap, coalesce(at_level, 'inf'::DOUBLE) * weight) AS target
  FROM levels, at_level),
passes AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target) AS BIGINT) // source_size ELSE 0 END AS passes FROM goal),
left_over AS (SELECT *, CAST(floor(target) AS BIGINT) - passes * source_size AS left_words FROM passes),
ordered AS (
  SELECT s.*, g.source_size, g.target, g.passes, g.left_words,
         sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.doc_id NULLS FIRST, s.size ROWS UNBOUNDED PRECEDING) - s.size AS before
  FROM sized s JOIN left_over g ON s.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
       CAST(passes * size + greatest(0, least(size, left_words - before)) AS BIGINT) AS taken
FROM ordered
"""
