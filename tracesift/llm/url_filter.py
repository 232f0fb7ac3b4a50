"""URL filters: host-suffix x path-prefix expressions, hash-prefix equi-join, digest confirmation.

JVM only: every step is a built-in function or a join.

A rule (host, path, verdict) fits a URL if the URL's host is the rule's host or a subdomain of it
and the URL's path starts with the rule's path. Of the rules that fit, the longest expression
(host and path) wins; between equal lengths the longer host, then ``block``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .support import lower_ascii

PREFIX_HEX = 8  # the join key is the first 32 bits of the digest
MAX_LABELS, MAX_PATH_LENGTHS = 127, 2048  # a DNS name has at most 127 labels; lengths that a rule list may use


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty if there is none."""
    return lower_ascii(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1))


def url_path(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    u = F.coalesce(url.cast("string"), F.lit(""))
    at = F.instr(u, "://")
    return F.when(at > 0, F.substr(u, at + 3)).otherwise(F.lit(""))


def _digest(host: Column, path: Column) -> Column:
    # the host's length keeps ("a.com", "/b") apart from any other cut of the same characters
    return F.sha2(F.concat(F.length(host).cast("string"), F.lit(":"), host, path), 256)


def prepare_rules(rules: DataFrame) -> DataFrame:
    """Rules with digest and join key; rows with a null host or verdict are no rules, a null path is
    the empty path, and of repeated rules with differing verdicts ``block`` holds."""
    host, path = lower_ascii(F.col("host").cast("string")), F.coalesce(F.col("path").cast("string"), F.lit(""))
    clean = rules.select(host.alias("rule_host"), path.alias("rule_path"), F.col("verdict").alias("v")).filter("rule_host IS NOT NULL AND v IN ('allow', 'block')")
    digest = _digest(F.col("rule_host"), F.col("rule_path"))
    return clean.groupBy("rule_host", "rule_path").agg(F.max("v").alias("rule_verdict")).withColumn("rule_digest", digest).withColumn("key", F.substring("rule_digest", 1, PREFIX_HEX))


def filter_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """One row per input row: id, host, path, rule (host and path of the winning rule, else null), verdict.

    Null URLs and URLs without ``://`` have an empty host and path, fit no rule and get ``default``.
    Very long URLs are judged whole. Repeated rows stay repeated; other columns are ignored, whatever their names; an empty table or an
    empty rule list works. Distinct (host, path) pairs are judged once, so a URL or host that holds a
    third of the rows costs one judgement; the verdicts come back by an equi-join on the pair.

    Only expressions of a shape that some rule has are made: up to the largest label count and the
    distinct path lengths of the rules. The driver sees those few integers and no rule or URL.
    """
    ready = prepare_rules(rules)
    shapes = ready.agg(
        F.max(F.size(F.split("rule_host", r"\."))).alias("labels"),
        F.collect_set(F.length("rule_path")).alias("lengths"),
    ).first()
    labels, lengths = shapes["labels"] or 0, sorted(shapes["lengths"] or [])
    if labels > MAX_LABELS or len(lengths) > MAX_PATH_LENGTHS:
        raise ValueError(f"rules with {labels} labels and {len(lengths)} path lengths: more than {MAX_LABELS} or {MAX_PATH_LENGTHS}")

    urls = pages.select(F.col(id_col).alias(id_col), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path"))
    pairs = urls.select("host", "path").filter("host <> ''").distinct()
    suffixes = F.array_distinct(F.array(*[F.substring_index("host", ".", -j) for j in range(1, labels + 1)])) if labels else F.array().cast("array<string>")
    fitting = [F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in lengths]
    prefixes = F.array_compact(F.array(*fitting)) if fitting else F.array().cast("array<string>")
    expressions = (
        pairs.select("host", "path", F.explode(suffixes).alias("h"), prefixes.alias("ps"))
        .select("host", "path", "h", F.explode("ps").alias("p"))
        .select("host", "path", _digest(F.col("h"), F.col("p")).alias("digest"))
        .withColumn("key", F.substring("digest", 1, PREFIX_HEX))
    )
    hits = expressions.join(ready, "key").filter(F.col("digest") == F.col("rule_digest"))
    rank = F.struct(F.length("rule_host") + F.length("rule_path"), F.length("rule_host"), F.col("rule_verdict"))
    best = hits.groupBy("host", "path").agg(F.max_by(F.struct(F.concat("rule_host", "rule_path").alias("rule"), F.col("rule_verdict").alias("verdict")), rank).alias("best"))
    return urls.join(best, ["host", "path"], "left").select(
        id_col, "host", "path", F.col("best.rule").alias("rule"), F.coalesce(F.col("best.verdict"), F.lit(default)).alias("verdict")
    )


def rules_frame(spark, rules: list[tuple[str, str, str]]) -> DataFrame:
    """A small rule list given in code; long lists are tables with these three columns."""
    rows = [spark.range(1).select(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(v).alias("verdict")) for h, p, v in rules]
    return reduce(DataFrame.unionByName, rows)
