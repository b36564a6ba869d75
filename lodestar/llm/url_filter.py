"""URL filtering by host-suffix and path-prefix expressions.

Each URL is expanded into the expressions ``host suffix + path prefix`` that a rule could be written
as; expressions meet the rules in an equi-join on the first hex digits of a SHA-256 digest, and the
whole digest decides. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, unused

#: Hex digits of the digest that the join compares first.
SHORT = 8


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end; empty where there is no ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _digest(host: Column, path: Column) -> Column:
    # the zero byte keeps ("a", "b/") and ("a/b", "/") apart
    return F.sha2(F.concat(host, F.lit("\0"), path), 256)


def _rules(rules: DataFrame) -> DataFrame:
    """Rules with the leading slash of the path, one row per (host, path): block wins over allow."""
    r = rules.where("host is not null and path is not null").select(
        ascii_lower(F.col("host")).alias("rule_host"), F.concat(F.lit("/"), "path").alias("rule_path"), "verdict", F.concat("host", F.lit("/"), "path").alias("rule")
    )
    return r.groupBy("rule_host", "rule_path").agg(F.max("verdict").alias("verdict"), F.min("rule").alias("rule"))


def filter_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """Judge every row's URL; adds host, path, rule and verdict.

    ``rules`` has host, path (without its first slash, empty for a whole host) and verdict. A rule fits
    its host and all subdomains if the URL's path starts with the rule's; the longest host wins, then
    the longest path; equal rules with both verdicts block. URLs that no rule fits get ``default``.
    Null URLs and those without ``://`` have empty host and path and no rule. All rows stay, repeated
    ones too; columns of the pages named as ours are replaced.
    """
    rules = _rules(rules)
    # Prefix lengths that rules have: at most as many as the longest rule has characters.
    lengths = sorted(r[0] for r in rules.select(F.length("rule_path")).distinct().collect())
    hosts = sorted(r[0] for r in rules.select(F.size(F.split("rule_host", r"\."))).distinct().collect())

    pages = pages.drop("host", "path", "rule", "verdict").withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    keys = pages.where("host <> ''").select("host", "path").distinct()
    labels = F.split("host", r"\.")
    suffixes = F.filter(F.array(*[F.when(F.size(labels) >= n, F.array_join(F.slice(labels, -n, n), ".")) for n in hosts]), lambda x: x.isNotNull()) if hosts else F.array().cast("array<string>")
    prefixes = F.filter(F.array(*[F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in lengths]), lambda x: x.isNotNull()) if lengths else F.array().cast("array<string>")
    tried = keys.select("host", "path", F.explode(suffixes).alias("h"), prefixes.alias("p")).select("host", "path", "h", F.explode("p").alias("p"))
    tried = tried.withColumn("digest", _digest(F.col("h"), F.col("p"))).withColumn("short", F.substring("digest", 1, SHORT)).select("host", "path", "digest", "short")
    known = rules.withColumn("full", _digest(F.col("rule_host"), F.col("rule_path"))).withColumn("short", F.substring("full", 1, SHORT))
    fits = tried.join(known, "short").where(F.col("digest") == F.col("full"))
    best = fits.groupBy("host", "path").agg(F.max(F.struct(F.length("rule_host").alias("a"), F.length("rule_path").alias("b"), "rule", "verdict")).alias("best"))
    # Rows without a host fit no rule; a number of their own keeps them from meeting in one task.
    salt = unused(pages, "salt")
    pages_by = pages.withColumn(salt, F.when(F.col("host") == "", F.monotonically_increasing_id()).otherwise(-1))
    out = pages_by.join(best.withColumn(salt, F.lit(-1).cast("long")), ["host", "path", salt], "left")
    return out.select(*[c for c in pages.columns], F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
