"""The registered queries of the operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .decontamination import decontaminate
from .line_dedup import dedup_lines
from .lm_scoring import score_texts
from .packing import BUCKETS, MAX_LENGTH, PIECE_ROWS, TOKEN_BUDGET, pack
from .sharding import PIECE_ROWS as SHARD_PIECE_ROWS
from .sharding import shard_documents
from .url_filters import judge_urls

SHARDS = 40
#: Words in the longest n-grams of the language model.
LM_ORDER = 3

RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", (F.col("n_items") >= 2).alias("contaminated"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), keep_text=False)


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return judge_urls(table(spark, sf_dir, "pages"), rules)


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores with six decimals: sums of many terms differ in the last bits with the order of addition."""
    found = score_texts(table(spark, sf_dir, "documents"), order=LM_ORDER)
    return found.withColumns({c: F.round(c, 6) for c in ("base_score", "score")})


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents"), keep_text=False).select("doc_id", "n_lines", "n_dropped", "kept_sha256")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"), SHARDS)


_FOLD = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACE = r"' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

OP2_SQL = f"""
WITH words AS (
  SELECT 'd' AS kind, CAST(doc_id AS VARCHAR) AS id, regexp_extract_all({_FOLD.format('text')}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
  UNION ALL
  SELECT 'b', CAST(item_id AS VARCHAR), regexp_extract_all({_FOLD.format('text')}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') FROM benchmark
), windows AS (
  SELECT DISTINCT id AS item, least(8, len(w)) AS size, unnest([array_to_string(w[i:i + least(8, len(w)) - 1], ' ') FOR i IN range(1, len(w) - least(8, len(w)) + 2)]) AS win
  FROM words WHERE kind = 'b' AND len(w) > 0
), sizes AS (SELECT DISTINCT size FROM windows),
starts AS (
  SELECT id, size, unnest(range(1, len(w) - size + 2)) AS i, w FROM words, sizes WHERE kind = 'd' AND len(w) >= size
), found AS (
  SELECT s.id, s.i, s.size, v.item FROM starts s JOIN windows v ON v.size = s.size AND v.win = array_to_string(s.w[s.i:s.i + s.size - 1], ' ')
), hit AS (
  SELECT id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT id, unnest(range(i, i + size)) AS p FROM found) GROUP BY id
), items AS (
  SELECT id, count(DISTINCT item) AS n_items, sha256(string_agg(DISTINCT item, ',' ORDER BY item)) AS sha FROM found GROUP BY id
)
SELECT d.doc_id, CAST(coalesce(len(w.w), 0) AS BIGINT) AS n_words, CAST(coalesce(h.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(t.n_items, 0) AS BIGINT) AS n_items,
       coalesce(t.sha, sha256('')) AS items_sha256, coalesce(t.n_items, 0) >= 2 AS contaminated
FROM documents d JOIN words w ON w.kind = 'd' AND w.id = CAST(d.doc_id AS VARCHAR) LEFT JOIN hit h ON h.id = w.id LEFT JOIN items t ON t.id = w.id
"""


def _packing_sql() -> str:
    """The recurrence over bucket bounds, a bucket at a time, then ranks within buckets."""
    steps = [
        "sized AS (SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) + 1 AS n FROM documents)",
        f"chunks AS MATERIALIZED (SELECT doc_id, chunk, least({MAX_LENGTH}, n - chunk * {MAX_LENGTH}) AS n_tokens FROM (SELECT doc_id, n, unnest(range(0, (n + {MAX_LENGTH - 1}) // {MAX_LENGTH})) AS chunk FROM sized))",
        "h AS MATERIALIZED (SELECT n_tokens AS len, row_number() OVER (ORDER BY n_tokens) AS j, sum(count(*)) OVER (ORDER BY n_tokens) AS c, sum(sum(n_tokens)) OVER (ORDER BY n_tokens) AS t FROM chunks GROUP BY n_tokens)",
        "b1 AS MATERIALIZED (SELECT j, len * c - t AS best, [len] AS path FROM h)",
    ]
    for k in range(2, BUCKETS + 1):
        steps.append(
            f"m{k} AS MATERIALIZED (SELECT j, cost, path FROM (SELECT j.j, p.best + j.len * (j.c - i.c) - (j.t - i.t) AS cost, p.path, row_number() OVER (PARTITION BY j.j ORDER BY p.best + j.len * (j.c - i.c) - (j.t - i.t), i.j) AS nth "
            f"FROM h j JOIN h i ON i.j < j.j JOIN b{k - 1} p ON p.j = i.j) WHERE nth = 1)"
        )
        steps.append(f"b{k} AS MATERIALIZED (SELECT b.j, CASE WHEN m.cost < b.best THEN m.cost ELSE b.best END AS best, CASE WHEN m.cost < b.best THEN list_append(m.path, h.len) ELSE b.path END AS path FROM b{k - 1} b JOIN h USING (j) LEFT JOIN m{k} m USING (j))")
    steps.append(f"bounds AS (SELECT unnest(path) AS bucket FROM b{BUCKETS} WHERE j = (SELECT max(j) FROM h))")
    steps.append("placed AS (SELECT doc_id, chunk, n_tokens, (SELECT min(bucket) FROM bounds WHERE bucket >= n_tokens) AS bucket FROM chunks)")
    piece = f"(((doc_id % 2147483648) * 2654435761) >> 16) % (1 + (SELECT count(*) FROM chunks) // {BUCKETS * PIECE_ROWS})"
    steps.append(f"ranked AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY {piece}, doc_id, chunk, n_tokens) - 1 AS r, greatest(1, {TOKEN_BUDGET} // bucket) AS room FROM placed)")
    return f"WITH {',\n'.join(steps)}\nSELECT doc_id, CAST(chunk AS INTEGER) AS chunk, CAST(n_tokens AS BIGINT) AS n_tokens, CAST(bucket AS BIGINT) AS bucket, CAST(r // room AS BIGINT) AS batch, CAST(r % room AS BIGINT) AS place, CAST(bucket - n_tokens AS BIGINT) AS padding FROM ranked"


OP3_SQL = _packing_sql()

OP6_SQL = f"""
WITH rules(rh, rp, v) AS (VALUES {', '.join(map(str, RULES))}),
parts AS (
  SELECT page_id, coalesce({_FOLD.format("regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1)")}, '') AS host,
         coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path FROM pages
), best AS (
  SELECT page_id, host, path, rh, rp, v, row_number() OVER (PARTITION BY page_id ORDER BY length(rh) + length(rp) DESC NULLS LAST) AS nth
  FROM parts LEFT JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)
)
SELECT page_id, host, path, rh || rp AS rule, coalesce(v, 'allow') AS verdict FROM best WHERE nth = 1
"""

OP8_SQL = f"""
WITH lines AS (
  SELECT doc_id, unnest(range(1, len(l) + 1)) AS i, unnest(l) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)
), keyed AS (SELECT doc_id, i, line, {_FOLD.format(f"trim(line, {_SPACE})")} AS k FROM lines),
often AS (SELECT k, max(doc_id) AS home FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
judged AS (SELECT x.*, o.home IS NOT NULL AND o.home <> x.doc_id AS gone FROM keyed x LEFT JOIN often o ON o.k = x.k)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CAST(gone AS BIGINT)) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""


def _crc_step(c: int) -> int:
    for _ in range(8):
        c = c >> 1 ^ 0xEDB88320 * (c & 1)
    return c


_CRC_TABLE = ", ".join(str(_crc_step(c)) for c in range(256))

def _crc_sql(hexes: str) -> str:
    """The checksum of a list of bytes in hexadecimal."""
    return f"CAST(xor(list_reduce(list_transform(list_prepend('FFFFFFFF', {hexes}), lambda x: CAST('0x' || x AS BIGINT)), lambda c, b: xor(c >> 8, [{_CRC_TABLE}][(xor(c, b) & 255) + 1])), 4294967295) AS BIGINT)"


OP7_SQL = f"""
WITH docs AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, {_crc_sql("regexp_extract_all(hex(encode(coalesce(CAST(doc_id AS VARCHAR), ''))), '..')")} % 7 = 2 AS held_out,
         list_concat([chr(10)], regexp_extract_all({_FOLD.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+'), [chr(10)]) AS w FROM documents
), t AS MATERIALIZED (
  SELECT r, held_out, unnest(w[2:]) AS c, unnest(w[1:len(w) - 1]) AS b, unnest(list_prepend(NULL, w[1:len(w) - 2])) AS a FROM docs
), one AS MATERIALIZED (SELECT c, count(*) AS n FROM t WHERE NOT held_out GROUP BY 1),
two AS MATERIALIZED (SELECT b, c, count(*) AS n FROM t WHERE NOT held_out GROUP BY 1, 2),
three AS MATERIALIZED (SELECT a, b, c, count(*) AS n FROM t WHERE NOT held_out AND a IS NOT NULL GROUP BY 1, 2, 3),
after_one AS (SELECT b, sum(n) AS n, count(*) AS types FROM two GROUP BY 1),
after_two AS (SELECT a, b, sum(n) AS n, count(*) AS types FROM three GROUP BY 1, 2),
whole AS (SELECT sum(n)::DOUBLE AS n, count(*)::DOUBLE AS types, coalesce(count(*) FILTER (n = 1) / nullif(count(*) FILTER (n = 1) + 2 * count(*) FILTER (n = 2), 0) * CASE WHEN count(*) FILTER (n = 1) > 0 THEN 1 END, 0.5)::DOUBLE AS discount FROM one),
first_ AS (
  SELECT t.*, coalesce(one.n, 0) AS n, CASE WHEN one.n IS NULL THEN discount * types / whole.n ELSE (one.n - discount) / whole.n END AS p, log10((coalesce(one.n, 0) + 1) / (whole.n + types + 1)) AS base
  FROM t LEFT JOIN one ON one.c = t.c, whole
), second AS (
  SELECT f.r, f.a, f.b, f.c, f.n, f.base, CASE WHEN h.n IS NULL THEN f.p ELSE (coalesce(two.n, 0) + h.types * f.p) / (h.n + h.types) END AS p
  FROM first_ f LEFT JOIN after_one h ON h.b = f.b LEFT JOIN two ON two.b = f.b AND two.c = f.c
), third AS (
  SELECT s.r, s.n, s.base, CASE WHEN h.n IS NULL THEN s.p ELSE (coalesce(three.n, 0) + h.types * s.p) / (h.n + h.types) END AS p
  FROM second s LEFT JOIN after_two h ON h.a = s.a AND h.b = s.b LEFT JOIN three ON three.a = s.a AND three.b = s.b AND three.c = s.c
)
SELECT any_value(d.doc_id) AS doc_id, any_value(d.held_out) AS held_out, count(*) AS n_tokens, count(*) FILTER (x.n > 0) AS n_known, CAST((SELECT n FROM whole) AS BIGINT) AS train_tokens,
       round(sum(x.base), 6) AS base_score, round(sum(log10(x.p)), 6) AS score
FROM third x JOIN docs d ON d.r = x.r GROUP BY x.r
"""

OP9_SQL = f"""
WITH RECURSIVE docs AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, CAST(coalesce(doc_id, 0) AS BIGINT) AS k, regexp_extract_all(hex(encode(coalesce(text, ''))), '..') AS bytes FROM documents
), sums AS (
  SELECT r, doc_id, k, CAST(len(bytes) + 16 AS BIGINT) AS size,
         {_crc_sql("bytes")} AS text_crc32
  FROM docs
), jump(n, key, k, b, j) AS (
  SELECT n, k, CAST(k AS UHUGEINT), CAST(-1 AS BIGINT), CAST(0 AS BIGINT) FROM (SELECT DISTINCT k FROM docs), (VALUES ({SHARDS}), ({SHARDS + 1})) AS t(n)
  UNION ALL
  SELECT n, key, nk, j, CAST(floor((j + 1) * (2147483648.0::DOUBLE / (CAST(nk // 8589934592 AS DOUBLE) + 1.0::DOUBLE))) AS BIGINT)
  FROM (SELECT n, key, j, (k * 2862933555777941757::UHUGEINT + 1::UHUGEINT) % 18446744073709551616::UHUGEINT AS nk FROM jump WHERE j < n)
), homes AS (SELECT n, key, max(j) AS shard FROM jump WHERE j < n GROUP BY n, key)
SELECT s.doc_id, s.size, s.text_crc32, 'key' AS law, CAST(a.shard AS INTEGER) AS shard,
       row_number() OVER (PARTITION BY a.shard ORDER BY (((s.k % 2147483648) * 2654435761) >> 16) % (1 + (SELECT count(*) FROM documents) // {SHARDS * SHARD_PIECE_ROWS}), s.k, s.size, s.text_crc32) - 1 AS slot,
       CAST(g.shard AS INTEGER) AS grown_shard
FROM sums s JOIN homes a ON a.n = {SHARDS} AND a.key = s.k JOIN homes g ON g.n = {SHARDS + 1} AND g.key = s.k
"""

QUERIES = {f.__name__: f for f in (op2_decontamination, op3_packing, op6_url_filters, op7_lm_scoring, op8_line_dedup, op9_sharding)}
ORACLES = {"op2_decontamination": OP2_SQL, "op3_packing": OP3_SQL, "op6_url_filters": OP6_SQL, "op7_lm_scoring": OP7_SQL, "op8_line_dedup": OP8_SQL, "op9_sharding": OP9_SQL}
