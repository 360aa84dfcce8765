"""op7: near-duplicates among all embeddings."""

from pyspark.sql import DataFrame, SparkSession

from . import forest

NAME = "op7_forest_near_dedup"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), least=0.98)


ORACLE_SQL = r"""
WITH RECURSIVE fine AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS norm
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM fine a JOIN fine b ON a.label = b.label AND a.vec_id != b.vec_id
  WHERE a.norm > 0 AND b.norm > 0 AND list_dot_product(a.v, b.v) / (a.norm * b.norm) >= 0.98),
reach AS (
  SELECT vec_id AS id, vec_id AS least FROM embeddings
  UNION SELECT l.b, r.least FROM reach r JOIN links l ON l.a = r.id WHERE r.least < l.b)
SELECT e.vec_id, coalesce(n, 0) AS n_links, component_id, component_id = e.vec_id AS kept
FROM embeddings e LEFT JOIN (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a) USING (vec_id)
JOIN (SELECT id AS vec_id, min(least) AS component_id FROM reach GROUP BY id) USING (vec_id)
"""
