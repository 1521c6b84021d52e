"""URL filtering against a rule list by hashed host-suffix and path-prefix expressions, in DataFrame operations only.

A rule is (host, path, verdict). It fits a URL if the URL's host is the rule's host or a subdomain of it and the URL's path
starts with the rule's path. Each URL is expanded into the expressions host-suffix + path-prefix that a rule could have, where
path prefixes end at a slash (a rule's path is anchored at its last slash; what follows is confirmed on the candidates). The
expressions meet the rules in an equi-join on the first hexadecimal digits of their SHA-256; then the full digest and the
rule's whole path are confirmed, and the longest rule wins (of equally long ones that with the longer host, of rules for the
same host and path the blocking one).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Hexadecimal digits of a digest that the join compares.
PREFIX_DIGITS = 8
#: Rules that are broadcast at most (about 200 bytes each); a longer list is joined by shuffle.
BROADCAST_RULES = 20_000


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for a null URL or one without ://."""
    found = lambda k: F.coalesce(F.regexp_extract(url, r"://([^/?#]*)([^?#]*)", k), F.lit(""))
    return F.translate(found(1), UPPER, LOWER), found(2)


def prepare_rules(rules: DataFrame) -> DataFrame:
    """One row for each (host, path) with its join prefix, digest and precedence; rules with a null in them fit nothing."""
    known = rules.select(F.translate("host", UPPER, LOWER).alias("rule_host"), F.col("path").alias("rule_path"), "verdict").dropna()
    known = known.groupBy("rule_host", "rule_path").agg(F.max("verdict").alias("rule_verdict"))  # "block" sorts after "allow"
    anchor = F.regexp_extract("rule_path", r"^(?s:.*)/", 0)
    digest = F.sha2(F.concat("rule_host", anchor), 256)
    return known.select("*", digest.alias("rule_digest"), F.substring(digest, 1, PREFIX_DIGITS).alias("prefix"), (F.size(F.split("rule_host", r"\.", -1))).alias("labels"), F.length(F.regexp_replace(anchor, r"[^/]", "")).alias("slashes"))


def filter_urls(pages: DataFrame, rules: DataFrame | Sequence[tuple[str, str, str]], default: str = "allow") -> DataFrame:
    """Judge every URL: page_id, host, path, rule, verdict.

    rule is the winning rule's host and path in one string, null if no rule fits; verdict is the rule's, else ``default``, the
    method's answer for URLs that no list names (null and malformed URLs have empty host and path, and so ``default``, unless
    a rule has an empty host). Each row is judged by its url alone: repeated rows and ids stay, null ids stay, other columns
    are ignored, an empty table gives an empty result. Expressions are made for distinct hosts and paths only and no longer
    than the longest rule, so a hot host costs one expansion for each of its paths and a very long URL no more than the rules. The
    rows of a hot URL meet one row in the last join; adaptive execution splits the part that they fill.
    """
    if not isinstance(rules, DataFrame):
        given = F.array(*(F.struct(*map(F.lit, r)) for r in rules)).cast("array<struct<host:string,path:string,verdict:string>>")
        rules = pages.sparkSession.range(1).select(F.inline(given))
    known = prepare_rules(rules)
    n, labels, slashes = known.agg(F.count("*"), F.coalesce(F.max("labels"), F.lit(0)), F.coalesce(F.max("slashes"), F.lit(0))).first()
    known = known.drop("labels", "slashes")
    host, path = url_parts(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))

    parts = F.split("host", r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.least(F.size(parts), F.lit(max(labels, 1)))), lambda i: F.array_join(F.slice(parts, F.size(parts) - i + 1, i), "."))
    depth = F.least(F.size(F.split("path", "/", -1)) - 1, F.lit(slashes))
    prefixes = F.transform(F.sequence(F.lit(0), depth), lambda i: F.when(i == 0, F.lit("")).otherwise(F.concat(F.call_function("substring_index", F.col("path"), F.lit("/"), i), F.lit("/"))))
    texts = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p))))
    expanded = rows.select("host", "path").distinct().select("host", "path", F.explode(F.transform(texts, lambda x: F.sha2(x, 256))).alias("digest"))
    expanded = expanded.withColumn("prefix", F.substring("digest", 1, PREFIX_DIGITS))
    fits = expanded.join(F.broadcast(known) if n <= BROADCAST_RULES else known, "prefix").filter((F.col("digest") == F.col("rule_digest")) & F.startswith("path", "rule_path"))
    rule = F.concat("rule_host", "rule_path")
    best = fits.groupBy("host", "path").agg(F.max(F.struct(F.length(rule).alias("n"), F.length("rule_host").alias("h"), rule.alias("rule"), F.col("rule_verdict").alias("verdict"))).alias("best"))
    return rows.join(best, ["host", "path"], "left").select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
