"""op6: find personal data, and what discloses it, in all documents."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import pii

NAME = "op6_pii_disclosure"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    counts = [F.expr(f"size(filter(found, x -> x.k = {i}))").cast("long").alias(f"n_{k}") for i, k in enumerate(pii.KINDS)]
    every = F.concat("found", "added")
    return found.select("doc_id", *counts, F.sha2(pii.as_text(F.col("found")), 256).alias("base_sha256"), pii.as_text(every).alias("spans"), F.size(every).cast("long").alias("n_spans"), F.sha2(pii.redacted(F.col("text"), every), 256).alias("redacted_sha256"))


ORACLE_SQL = r"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS r FROM documents),
kinds(k, kind) AS (VALUES (0, 'email'), (1, 'ip'), (2, 'card'), (3, 'phone'), (4, 'secret'), (5, 'term')),
parts AS (
  SELECT r, 0 AS k, regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+') AS m, string_split_regex(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+') AS g FROM docs
  UNION ALL SELECT r, 1, regexp_extract_all(text, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)'), string_split_regex(text, '[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)') FROM docs
  UNION ALL SELECT r, 2, regexp_extract_all(text, '[0-9]([\x20-]?[0-9])+'), string_split_regex(text, '[0-9](?:[\x20-]?[0-9])+') FROM docs
  UNION ALL SELECT r, 3, regexp_extract_all(text, '\+[0-9][\x20().0-9-]+[0-9]'), string_split_regex(text, '\+[0-9][\x20().0-9-]+[0-9]') FROM docs
  UNION ALL SELECT r, 4, regexp_extract_all(text, '[A-Za-z0-9]{20,}'), string_split_regex(text, '[A-Za-z0-9]{20,}') FROM docs),
each AS (SELECT r, k, unnest(m) AS m, unnest(g[1:len(m)]) AS g, unnest(g[2:len(m) + 1]) AS a, unnest(range(len(m))) AS i FROM parts),
placed AS (
  SELECT r, k, m, right(g, 80) AS before, left(a, 80) AS after, regexp_replace(m, '[^0-9]', '', 'g') AS d,
         CAST(sum(length(g) + length(m)) OVER (PARTITION BY r, k ORDER BY i) AS BIGINT) AS e FROM each),
base AS (
  SELECT r, k, kind, e - length(m) AS s, e, m, d, before, after FROM placed JOIN kinds USING (k)
  WHERE k = 0
     OR k = 1 AND list_bool_and(list_transform(string_split(m, '.'), lambda x: length(ltrim(x, '0')) <= 3 AND coalesce(try_cast(ltrim(x, '0') AS INT), 0) <= 255))
     OR k = 2 AND length(d) BETWEEN 13 AND 19 AND list_sum(list_transform(range(length(d)), lambda i: CASE
          WHEN i % 2 = 0 THEN CAST(d[length(d) - i] AS INT) WHEN CAST(d[length(d) - i] AS INT) > 4 THEN 2 * CAST(d[length(d) - i] AS INT) - 9
          ELSE 2 * CAST(d[length(d) - i] AS INT) END)) % 10 = 0
     OR k = 3 AND length(d) BETWEEN 9 AND 15
     OR k = 4 AND length(d) >= 4 AND length(m) - length(d) >= 4),
classes AS (
  SELECT r, before, after, 1 AS level, kind || '=' || lower(m) AS entity FROM base UNION ALL SELECT r, before, after, 3, kind FROM base
  UNION ALL SELECT r, before, after, 2, CASE k WHEN 0 THEN 'email@' || lower(split_part(m, '@', -1)) WHEN 1 THEN 'ip:' || split_part(m, '.', 1) || '.' || split_part(m, '.', 2)
    WHEN 2 THEN 'card:' || left(d, 6) ELSE 'phone:' || left(d, 4) END FROM base WHERE k < 4),
words AS (
  SELECT r, CAST(sum(length(w) + 1) OVER (PARTITION BY r ORDER BY j) AS BIGINT) - length(w) - 1 + length(regexp_extract(w, '^[^\p{L}]*')) AS s, regexp_extract(w, '^[^\p{L}]*(\p{L}[\p{L}''-]*)[^\p{L}]*$', 1) AS term
  FROM (SELECT r, unnest(string_split_regex(text, '[\x20\x09-\x0D]')) AS w, unnest(range(len(string_split_regex(text, '[\x20\x09-\x0D]')))) AS j FROM docs)),
beside AS (
  SELECT r, level, entity, unnest((string_split_regex(before, '[\x20\x09-\x0D]'))[CASE WHEN length(before) = 80 THEN 2 ELSE 1 END:]
    || (string_split_regex(after, '[\x20\x09-\x0D]'))[:CASE WHEN length(after) = 80 THEN -2 ELSE -1 END]) AS w FROM classes),
met AS (SELECT DISTINCT r, level, entity, regexp_extract(w, '^[^\p{L}]*(\p{L}[\p{L}''-]*)[^\p{L}]*$', 1) AS term FROM beside),
n_te AS (SELECT term, level, entity, count(*) AS n_te FROM met WHERE length(term) >= 3 GROUP BY ALL HAVING n_te >= 2),
n_e AS (SELECT entity, count(DISTINCT r) AS n_e FROM classes GROUP BY entity),
n_t AS (SELECT term, count(DISTINCT r) AS n_t FROM words GROUP BY term),
told AS (
  SELECT term, entity, level = 1 AND 2 * n_te >= n_t AS everywhere
  FROM (SELECT *, x2 * x2 AS x4 FROM (SELECT *, x * x AS x2 FROM (SELECT *, n_te::DOUBLE / n_t AS x FROM n_te JOIN n_e USING (entity) JOIN n_t USING (term)))), (SELECT count(*) AS n FROM docs)
  WHERE x4 * x4 * x2 * n >= n_e),
wanted AS (
  SELECT DISTINCT c.r, term FROM (SELECT DISTINCT r, entity FROM classes) c JOIN told USING (entity)
  UNION SELECT DISTINCT r, term FROM words WHERE term IN (SELECT term FROM told WHERE everywhere)),
spans AS (
  SELECT r, k, kind, s, e FROM base
  UNION ALL SELECT w.r, 5, 'term', s, s + length(w.term) FROM words w JOIN wanted USING (r, term)),
cut AS (
  SELECT r, kind, s, e, coalesce(max(e) OVER (PARTITION BY r ORDER BY s, e, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b,
         max(e) OVER (PARTITION BY r) AS z, row_number() OVER (PARTITION BY r ORDER BY s, e, k) AS o FROM spans),
clean AS (
  SELECT r, string_agg(substr(text, b + 1, s - b) || '[' || upper(kind) || ']', '' ORDER BY o) FILTER (s >= b) || substr(any_value(text), any_value(z) + 1) AS redacted
  FROM cut JOIN docs USING (r) GROUP BY r),
joined AS (
  SELECT r, count(*) FILTER (k = 0) AS n_email, count(*) FILTER (k = 1) AS n_ip, count(*) FILTER (k = 2) AS n_card, count(*) FILTER (k = 3) AS n_phone, count(*) AS n,
         string_agg(kind || ':' || s || ':' || e, ',' ORDER BY k, s) FILTER (k < 4) AS b, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY k, s) AS a
  FROM spans GROUP BY r)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone,
       sha256(coalesce(b, '')) AS base_sha256, coalesce(a, '') AS spans, coalesce(n, 0) AS n_spans, sha256(coalesce(redacted, text)) AS redacted_sha256
FROM docs LEFT JOIN joined USING (r) LEFT JOIN clean USING (r)
"""
