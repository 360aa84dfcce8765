"""op10: remove repeated 50-byte strings from all documents."""

from pyspark.sql import DataFrame, SparkSession

from . import suffixes

NAME = "op10_suffix_array_dedup"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep_bytes=False)


ORACLE_SQL = r"""
WITH raw AS (SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
windows AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 100)) AS w FROM (SELECT doc_id, h, unnest(range(n - 49)) AS i FROM raw WHERE n >= 50)),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY w) AS first FROM windows) WHERE doc_id > first),
runs AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 50 THEN 0 ELSE 1 END AS new FROM later),
spans AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS s FROM runs) GROUP BY doc_id, s),
cuts AS (SELECT doc_id, a, b, lead(a) OVER (PARTITION BY doc_id ORDER BY a) AS c FROM spans),
kept AS (
  SELECT r.doc_id, substr(any_value(h), 1, 2 * min(a)) || string_agg(substr(h, 2 * b + 1, 2 * (coalesce(c, n) - b)), '' ORDER BY a) AS k, CAST(sum(b - a) AS BIGINT) AS gone, count(*) AS spans
  FROM cuts JOIN raw r USING (doc_id) GROUP BY r.doc_id)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, coalesce(gone, 0) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(coalesce(k, h))) AS kept_sha256
FROM raw LEFT JOIN kept USING (doc_id)
"""
