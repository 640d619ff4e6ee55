"""URL filters: rules on host suffix and path prefix, found by an equi-join on short hash prefixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilwork.llm.common import LOWER, UPPER

HASH_PREFIX = 8  # hex digits of the digest that the join compares: 32 bits
DEFAULT_VERDICT = "allow"


def url_host(url: Column) -> Column:
    """Between the first `://` and the next `/`, `?`, `#` or the end, A-Z lower-cased; empty without `://` or url."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """What follows the host, up to `?`, `#` or the end; empty without `://` or url."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def prepare_rules(rules: DataFrame) -> DataFrame:
    """Digests of `rules` (host, path, verdict). A repeated rule counts once; of two verdicts `block` wins. Rules
    without a host are left out: no host is a part of every url. A null path is empty and fits every path."""
    expression = F.concat("host", F.lit("\n"), "path")
    return (rules.select(F.translate("host", UPPER, LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
            .filter("host <> '' and verdict is not null").groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
            .select("host", "path", "verdict", F.sha2(expression, 256).alias("digest"))
            .withColumn("short", F.substring("digest", 1, HASH_PREFIX)))


def judge_urls(urls: DataFrame, rules: DataFrame, url: str = "url", default: str = DEFAULT_VERDICT) -> DataFrame:
    """One row per distinct non-null `url`: url, host, path, rule (`host` + `path`; null if none fits), verdict.

    A url expands into every suffix of its host at a dot, times every prefix of its path that is as long as some
    rule's path. These expressions meet the rules on a short prefix of their digests; full digests confirm, and the
    longest rule wins (ties: the longer host). Empty tables give empty results; a url without `://` has an empty host
    and path, so no rule fits and `default` holds. The distinct path lengths of the rules, at most as many as the
    longest rule has characters, are the only thing that goes through the driver.
    """
    prepared = prepare_rules(rules)
    lengths = [r[0] for r in prepared.select(F.length("path")).distinct().collect()]
    distinct = urls.select(F.col(url).alias("url")).filter("url is not null").distinct()
    parts = distinct.select("url", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    suffixes = F.expr("transform(sequence(1, size(split(host, '[.]'))), k -> substring_index(host, '.', -k))")
    prefixes = F.array([F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in lengths] or [F.lit(None).cast("string")])
    expressions = F.flatten(F.transform(F.array_compact(prefixes), lambda p: F.transform(suffixes, lambda s: F.concat(s, F.lit("\n"), p))))
    found = (parts.select("url", F.explode(F.array_distinct(expressions)).alias("expression"))
             .select("url", F.sha2("expression", 256).alias("full")).withColumn("short", F.substring("full", 1, HASH_PREFIX)))
    order = F.struct((F.length("host") + F.length("path")).alias("n"), F.length("host").alias("h"),
                     F.concat("host", "path").alias("rule"), "verdict")
    best = found.join(prepared, "short").filter("full = digest").groupBy("url").agg(F.max(order).alias("best"))
    return parts.join(best, "url", "left").select("url", "host", "path", F.col("best.rule").alias("rule"),
                                                  F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def filter_pages(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = DEFAULT_VERDICT) -> DataFrame:
    """`pages` (page_id, url and more) with host, path, rule, verdict: one row per row, repeated rows too.

    A null url has an empty host and path, no rule and the default verdict. Other columns are not read.
    """
    judged = judge_urls(pages, rules, url, default)
    rows = pages.select("page_id", F.col(url).alias("url"))
    return rows.join(judged, "url", "left").select(
        "page_id", "url", F.coalesce("host", F.lit("")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "rule",
        F.coalesce("verdict", F.lit(default)).alias("verdict"))
