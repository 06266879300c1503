"""URL filters: host-suffix and path-prefix expressions looked up by short hash prefixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower

#: Rules up to this many rows are broadcast (a rule is a short string and a digest, so 200,000 of them stay below 50 MB); more are joined by a shuffle.
BROADCAST_RULES = 200_000


def url_host(url: Column) -> Column:
    rest = F.regexp_extract(url, "^(?s:.*?)://([^/?#]*)", 1)
    return F.coalesce(ascii_lower(rest), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def _key_path(path: Column) -> Column:
    """The path up to and with its last slash."""
    return F.regexp_extract(path, "^((?s:.*)/)?", 0)


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow", keep: tuple[str, ...] = ("page_id",), broadcast_rules: int = BROADCAST_RULES) -> DataFrame:
    """keep, host, path, rule and verdict for each row of pages; rules has host, path and verdict.

    A rule fits its host and all subdomains where the path starts with the
    rule's path; the longest host and path together wins, then the longer host,
    then block before allow. Each distinct host and path is expanded into its
    host suffixes crossed with its path prefixes, no deeper than any rule
    reaches; expressions meet rules on the first 32 bits of their SHA-256, and
    a meeting counts once the full digest agrees.

    A very long url makes as many expressions as the rules are deep, no more. A
    null url or one without :// has an empty host and path, which no rule
    fits; nulls in a rule make it no rule; repeated rows are judged alike and
    kept; other columns may have any names; an empty table gives no rows.
    """
    clean = rules.select(ascii_lower(F.col("host")).alias("rule_host"), F.col("path").alias("rule_path"), F.col("verdict").alias("rule_verdict")).na.drop()
    bounds = clean.agg(F.max(F.size(F.split("rule_host", r"\."))), F.max(F.size(F.split(_key_path(F.col("rule_path")), "/"))), F.count(F.lit(1))).first()
    labels, depth, n_rules = bounds[0] or 0, bounds[1] or 0, bounds[2]
    expression = F.concat(F.col("rule_host"), _key_path(F.col("rule_path")))
    indexed = clean.withColumn("_digest", F.sha2(expression, 256)).withColumn("_short", F.substring("_digest", 1, 8))
    indexed = F.broadcast(indexed) if n_rules <= broadcast_rules else indexed

    parsed = pages.select(*keep, url_host(F.col(url).cast("string")).alias("host"), url_path(F.col(url).cast("string")).alias("path"))
    parts = F.split("host", r"\.")
    hosts = F.transform(F.sequence(F.greatest(F.lit(1), F.size(parts) - labels + 1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    steps = F.split(_key_path(F.col("path")), "/")
    paths = F.transform(F.sequence(F.lit(1), F.least(F.size(steps), F.lit(max(depth, 1)))), lambda i: F.when(i == 1, F.lit("")).otherwise(F.concat(F.array_join(F.slice(steps, 1, i - 1), "/"), F.lit("/"))))
    expanded = F.flatten(F.transform(hosts, lambda h: F.transform(paths, lambda p: F.concat(h, p))))
    targets = parsed.select("host", "path").where(F.col("host") != "").distinct().select("host", "path", F.explode(F.array_distinct(expanded)).alias("_expression"))
    targets = targets.withColumn("_sha", F.sha2("_expression", 256)).withColumn("_short", F.substring("_sha", 1, 8))
    met = targets.join(indexed, "_short").where((F.col("_sha") == F.col("_digest")) & F.startswith(F.col("path"), F.col("rule_path")))
    met = met.where((F.col("host") == F.col("rule_host")) | F.endswith(F.col("host"), F.concat(F.lit("."), F.col("rule_host"))))
    order = F.struct((F.length("rule_host") + F.length("rule_path")).alias("a"), F.length("rule_host").alias("b"), (F.col("rule_verdict") == "block").alias("c"), F.col("rule_verdict").alias("d"))
    best = met.groupBy("host", "path").agg(F.max_by(F.struct(F.concat("rule_host", "rule_path").alias("rule"), "rule_verdict"), order).alias("_best"))
    return parsed.join(best, ["host", "path"], "left").select(*keep, "host", "path", F.col("_best.rule").alias("rule"), F.coalesce("_best.rule_verdict", F.lit(default)).alias("verdict"))
