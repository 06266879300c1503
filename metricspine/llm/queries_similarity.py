"""Registered queries of the similarity and repetition operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .jaccard_join import jaccard_components
from .queries_documents import _FOLD, table
from .repeated_bytes import remove_repeats


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), n=4, percent=85).select("doc_id", "n_shingles", "component_id")


def op10_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), depth=50).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


OP5_SQL = f"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all({_FOLD.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest([array_to_string(w[i:i + least(4, len(w)) - 1], ' ') FOR i IN range(1, len(w) - least(4, len(w)) + 2)]) AS s FROM words WHERE len(w) > 0
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
edges AS MATERIALIZED (
  SELECT a.doc_id AS a, b.doc_id AS b FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id
  JOIN sizes x ON x.doc_id = a.doc_id JOIN sizes y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 85 * (any_value(x.n) + any_value(y.n) - count(*))
), reach(doc_id, r) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT e.b, t.r FROM reach t JOIN edges e ON e.a = t.doc_id
)
SELECT d.doc_id, coalesce(any_value(s.n), 0) AS n_shingles, min(t.r) AS component_id
FROM documents d JOIN reach t ON t.doc_id = d.doc_id LEFT JOIN sizes s ON s.doc_id = d.doc_id GROUP BY d.doc_id
"""

OP10_SQL = """
WITH bytes AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
windows AS (SELECT doc_id, i, h[2 * i + 1:2 * i + 100] AS w FROM (SELECT doc_id, h, unnest(range(0, greatest(0, len(h) // 2 - 49))) AS i FROM bytes)),
gone AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY w) AS least FROM windows) WHERE least < doc_id),
marked AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 0 ELSE 1 END AS new FROM gone),
runs AS (SELECT doc_id, min(i) AS s, max(i) + 50 AS e FROM (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM marked) GROUP BY doc_id, run),
gaps AS (
  SELECT doc_id, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS a, s AS b FROM runs
  UNION ALL SELECT r.doc_id, max(r.e), any_value(len(b.h)) // 2 FROM runs r JOIN bytes b USING (doc_id) GROUP BY r.doc_id
), kept AS (SELECT g.doc_id, string_agg(b.h[2 * a + 1:2 * g.b], '' ORDER BY a) AS h FROM gaps g JOIN bytes b USING (doc_id) WHERE g.b > a GROUP BY g.doc_id),
counts AS (SELECT doc_id, sum(e - s) AS n_removed, count(*) AS n_spans FROM runs GROUP BY doc_id)
SELECT b.doc_id, len(b.h) // 2 AS n_bytes, CAST(coalesce(c.n_removed, 0) AS BIGINT) AS n_removed, coalesce(c.n_spans, 0) AS n_spans,
       sha256(unhex(CASE WHEN c.doc_id IS NULL THEN b.h ELSE coalesce(k.h, '') END)) AS kept_sha256
FROM bytes b LEFT JOIN counts c ON c.doc_id = b.doc_id LEFT JOIN kept k ON k.doc_id = b.doc_id
"""

QUERIES = {f.__name__: f for f in (op5_jaccard_join, op10_repeated_bytes)}
ORACLES = {"op5_jaccard_join": OP5_SQL, "op10_repeated_bytes": OP10_SQL}
