"""URL filters: host-suffix and path-prefix expressions joined on short hash prefixes.

Every distinct (host, path) is expanded into the expressions a rule could have written: each
suffix of the host at a label boundary, joined with each prefix of the path that is as long
as some rule's path. An expression and a rule meet on the first eight hex digits of their
SHA-256; the full digest then confirms the match, and of the confirmed rules the longest
decides. Only DataFrame functions are used.

Defined results: a null url, or one without ``://``, has empty host and path. An empty host has
one suffix, itself. A path that is empty starts no rule's path but an empty one. Of rules of
equal length the longer host decides, then ``block``. Repeated rows stay repeated; other
columns of the pages are kept, those named like a result column are replaced. Repeated
rules count once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RESULT = ("host", "path", "rule", "verdict")
SHORT = 8


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path) of an url; both empty when it is null or has no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(lower, F.lit("")), F.coalesce(path, F.lit(""))


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """``pages`` (with ``url``) plus host, path, rule and verdict.

    ``rules`` has host, path and verdict (allow or block). The distinct lengths of the rules'
    paths are read by the driver: one number per length, never more than the longest path has
    characters. The join is left to the optimizer, which broadcasts the rules only if their
    size is below its limit.
    """
    lengths = sorted(r[0] for r in rules.where("path is not null and host is not null")
                     .select(F.length("path")).distinct().collect())
    kept = [c for c in pages.columns if c not in RESULT]
    host, path = split_url(F.col("url"))
    # The pages' own columns travel as a struct, where their names clash with nothing.
    seen = pages.select(F.struct(F.lit(0).alias("-"), *kept).alias("row"), host.alias("host"), path.alias("path"))

    digest = F.sha2(F.concat("rule_host", "rule_path"), 256)
    known = rules.where("path is not null and host is not null").select(
        F.col("host").alias("rule_host"), F.col("path").alias("rule_path"), F.col("verdict").alias("rule_verdict")) \
        .distinct().select("*", digest.alias("rule_digest"), F.substring(digest, 1, SHORT).alias("short"))

    labels = F.split("host", "\\.")
    n = F.size(labels)
    suffixes = F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(labels, i, n - i + 1), "."))
    prefixes = F.filter(F.array(*[F.when(F.length("path") >= k, F.substring("path", 1, k)) for k in lengths])
                        if lengths else F.array().cast("array<string>"), lambda p: p.isNotNull())
    urls = seen.select("host", "path").distinct()
    expressions = urls.select("host", "path", F.explode(suffixes).alias("suffix"), prefixes.alias("prefixes")) \
        .select("host", "path", "suffix", F.explode("prefixes").alias("prefix")) \
        .select("host", "path", F.sha2(F.concat("suffix", "prefix"), 256).alias("digest")) \
        .withColumn("short", F.substring("digest", 1, SHORT))
    order = F.struct(F.length(F.concat("rule_host", "rule_path")), F.length("rule_host"), F.col("rule_verdict"))
    best = expressions.join(known, "short").where("digest = rule_digest").groupBy("host", "path").agg(
        F.max_by(F.struct(F.concat("rule_host", "rule_path").alias("rule"), F.col("rule_verdict").alias("said")),
                 order).alias("best"))
    return seen.join(best, ["host", "path"], "left").select(
        *[F.col("row").getField(c).alias(c) for c in kept], "host", "path", F.col("best.rule").alias("rule"),
        F.coalesce("best.said", F.lit(default)).alias("verdict"))
