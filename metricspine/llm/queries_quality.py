"""Registered queries of the quality operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .quality_classifier import score_quality
from .quality_rules import MIN_WORDS, PRIOR, PSEUDO, ROUNDS, RULES, START, judge_quality
from .queries_documents import _FOLD, table
from .text_stats import FUNCTION_WORDS


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = judge_quality(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def _vote_sql(rule) -> str:
    part, whole = (rule.part, "1") if rule.whole is None else (f"1000 * {rule.part}", rule.whole)
    tests = [f"WHEN {whole} > 0 AND {part} {t[0]} {t[1]} * {whole} THEN {v}" for v, t in ((1, rule.good), (-1, rule.bad)) if t]
    return f"CASE {' '.join(tests)} ELSE 0 END"


def _rules_sql() -> str:
    """Counts, votes and the rounds of expectation-maximisation, one after another."""
    words = "regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')"
    only = lambda c: f"length(text) - length(regexp_replace(text, '{c}', '', 'g'))"
    function = ", ".join(f"'{w}'" for w in dict.fromkeys(FUNCTION_WORDS))
    steps = [
        "texts AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)",
        f"tokens AS (SELECT doc_id, text, {words} AS w FROM texts)",
        "placed AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM tokens)",
        "windows AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, unnest([w[k:k + 2] FOR k IN range(1, len(w) - 1)]) AS x FROM tokens WHERE len(w) >= 3)",
        "often AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, x) AS n FROM windows) WHERE n > 1)",
        "repeated AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM often) GROUP BY doc_id)",
        "lines AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM texts) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id)",
        f"folded AS (SELECT doc_id, {_FOLD.format('word')} AS f, count(*) AS n FROM placed GROUP BY ALL)",
        f"tops AS (SELECT doc_id, max(n) AS top_count, coalesce(sum(n) FILTER (f IN ({function})), 0) AS n_function FROM folded GROUP BY doc_id)",
        "adjacent AS (SELECT doc_id, count(*) FILTER (word = before) AS n FROM (SELECT doc_id, word, lag(word) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM placed) GROUP BY doc_id)",
        f"""counted AS (
  SELECT t.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST({only('[#*$%&|<>]')} AS BIGINT) AS n_symbols,
    coalesce(l.n_lines, 0) AS n_lines, coalesce(l.n_dup_lines, 0) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, {only('[A-Z]')} AS n_upper, {only('[a-z]')} AS n_lower,
    {only('!')} AS n_exclaim, coalesce(p.n_function, 0) AS n_function, {only('[.,;:]')} AS n_marks, coalesce(a.n, 0) AS n_adjacent, coalesce(p.top_count, 0) AS top_count
  FROM tokens t LEFT JOIN lines l USING (doc_id) LEFT JOIN repeated r USING (doc_id) LEFT JOIN tops p USING (doc_id) LEFT JOIN adjacent a USING (doc_id))""",
        "voted AS MATERIALIZED (SELECT *, [" + ", ".join(_vote_sql(r) for r in RULES) + "] AS votes FROM counted)",
        "patterns AS MATERIALIZED (SELECT votes, count(*) AS n FROM voted GROUP BY votes)",
        "cast_ AS MATERIALIZED (SELECT votes, n, unnest(range(1, len(votes) + 1)) AS r, unnest(votes) AS v FROM patterns)",
        "start AS MATERIALIZED (SELECT r, v, g, b FROM (SELECT unnest(range(1, " + str(len(RULES) + 1) + ")) AS r), (VALUES " + ", ".join(f"({v}, {START[0][v + 1]}::DOUBLE, {START[1][v + 1]}::DOUBLE)" for v in (-1, 0, 1)) + ") AS s(v, g, b))",
        f"t0 AS (SELECT r, v, g, b, {PRIOR}::DOUBLE AS prior FROM start)",
    ]

    def posterior(i: int) -> str:
        return f"p{i} AS MATERIALIZED (SELECT votes, any_value(c.n) AS n, 1 / (1 + exp(ln(1 - any_value(prior)) + sum(ln(b)) - ln(any_value(prior)) - sum(ln(g)))) AS p FROM cast_ c JOIN t{i} USING (r, v) GROUP BY votes)"

    for i in range(ROUNDS):
        steps.append(posterior(i))
        steps.append(f"m{i} AS MATERIALIZED (SELECT sum(n * p) AS g, sum(n * (1 - p)) AS b, sum(n) AS n FROM p{i})")
        steps.append(
            f"t{i + 1} AS MATERIALIZED (SELECT s.r, s.v, (coalesce(sum(q.n * q.p), 0) + {PSEUDO} * any_value(s.g)) / (any_value(m.g) + {PSEUDO}) AS g, (coalesce(sum(q.n * (1 - q.p)), 0) + {PSEUDO} * any_value(s.b)) / (any_value(m.b) + {PSEUDO}) AS b, "
            f"(any_value(m.g) + {PSEUDO} * {PRIOR}) / (any_value(m.n) + {PSEUDO}) AS prior FROM start s CROSS JOIN m{i} m LEFT JOIN cast_ c ON c.r = s.r AND c.v = s.v LEFT JOIN p{i} q ON q.votes = c.votes GROUP BY s.r, s.v)"
        )
    steps.append(posterior(ROUNDS))
    failed = f"(n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words)"
    return f"WITH {',\n'.join(steps)}\nSELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, {failed} AS base_failed, NOT {failed} AND p >= 0.5 AS kept FROM voted JOIN p{ROUNDS} USING (votes)"


OP1_SQL = _rules_sql()

QUERIES = {f.__name__: f for f in (op1_quality_rules, op4_quality_classifier)}
ORACLES = {"op1_quality_rules": OP1_SQL}
