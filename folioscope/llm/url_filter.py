"""URL filters with redirect equivalence.

Rules name a host and a path prefix and allow or block. Urls that a rule fits get its verdict.
Urls that redirect to each other, or that name each other as canonical, are aliases: connected
components over those links carry block decisions to aliases that no rule fits. An explicit
allow always wins over a block that only reached a url through its aliases.
"""

from __future__ import annotations

import html
import re
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from folioscope.llm.components import connected_components

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ATTRIBUTE = r"""\s*=\s*["']?([^"'\s>]+)"""


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z in lower case; '' for null or without ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host, up to ? # or the end; '' for null or without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, or null. rules: (host, path, verdict).

    A rule fits its host and every subdomain when the path starts with the rule's path; ties in
    length go to the smaller rule string.
    """
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    by_text = sorted(rules, key=lambda r: r[0] + r[1], reverse=True)
    for rule_host, rule_path, verdict in sorted(by_text, key=lambda r: len(r[0] + r[1])):  # the last one is tried first
        fits = ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(rule_path)
        found = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def resolved_target(url: str, target: str) -> str | None:
    """A target without HTML entities, taken from the page's url unless it is absolute; null where that can't be read."""
    plain = html.unescape(target)
    if re.match(r"(?i)[a-z][a-z0-9+.-]*://", plain):
        return plain
    try:
        return urljoin(url, plain)
    except ValueError:
        return None


@F.pandas_udf(StringType())
def resolved_targets(urls: pd.Series, targets: pd.Series) -> pd.Series:
    return pd.Series([resolved_target(u, t) for u, t in zip(urls, targets, strict=True)], dtype=object)


def alias_links(pages: DataFrame) -> DataFrame:
    """(url, target): what the html of a page declares as its canonical address or redirects to.

    Reads link rel=canonical and meta refresh tags; relative targets are taken from the page's url and HTML entities
    are decoded. Pages whose url or html is null have none, neither have relative targets on pages with relative urls.
    """
    tags = pages.select("url", F.explode(F.regexp_extract_all("html", F.lit(r"(?is)(<(?:link|meta)\b[^>]*>)"), 1)).alias("tag"))
    canonical = F.when(F.col("tag").rlike(r"""(?is)\brel\s*=\s*["']?canonical\b"""), F.regexp_extract("tag", rf"(?is)\bhref{ATTRIBUTE}", 1))
    refresh = F.when(F.col("tag").rlike(r"""(?is)\bhttp-equiv\s*=\s*["']?refresh\b"""), F.regexp_extract("tag", r"""(?is)\burl\s*=\s*["']?((?:&#?\w+;|[^"'\s>;])+)""", 1))
    written = tags.select("url", F.coalesce(canonical, refresh).alias("target")).where("url IS NOT NULL AND target <> ''")
    return written.select("url", resolved_targets("url", "target").alias("target")).where("url IS NOT NULL AND target LIKE '%://%' AND url <> target")


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]], links: DataFrame | None = None, default: str = "allow") -> DataFrame:
    """Adds host, path, rule, verdict and via ('rule', 'alias' or 'default') to pages (page_id, url, html).

    links: (url, target) redirects and canonical links; by default those in the html. Components run
    over links only, never over all pages; urls stand as 64-bit hashes there. A component is blocked when
    any url in it, whether a page or only a target, has a block rule, and no url in it is allowed by
    a rule: an explicit allow anywhere in a component keeps its undecided aliases.
    Null and relative urls have empty hosts and get the default verdict; equal urls get equal verdicts;
    repeated rows stay; an empty table gives an empty result; other columns of pages stay.
    """
    links = alias_links(pages) if links is None else links.select("url", "target").where("url IS NOT NULL AND target IS NOT NULL")
    hashed = links.select(F.xxhash64("url").alias("a"), F.xxhash64("target").alias("b"), "url", "target")
    parts = connected_components(hashed.select("a", "b"))
    ends = hashed.select(F.col("a").alias("id"), F.col("url")).union(hashed.select("b", "target")).distinct()
    decided = ends.select("id", matching_rule(host_of(F.col("url")), path_of(F.col("url")), rules).verdict.alias("verdict")).where("verdict IS NOT NULL")
    by_part = (
        decided.join(parts, "id")
        .groupBy("component")
        .agg(F.bool_or(F.col("verdict") == "allow").alias("allowed"), F.bool_or(F.col("verdict") == "block").alias("blocked"))
        .select("component", F.when(F.col("allowed"), "allow").when(F.col("blocked"), "block").alias("_alias"))
    )
    reached = parts.join(by_part, "component").select(F.col("id").alias("_id"), "_alias")

    kept = pages.drop("host", "path", "rule", "verdict", "via", "_id", "_alias", "_fit")
    judged = (
        kept.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url")), "_id": F.xxhash64("url")})
        .withColumn("_fit", matching_rule(F.col("host"), F.col("path"), rules))
        .join(reached, "_id", "left")
    )
    via = F.when(F.col("_fit").isNotNull(), "rule").when(F.col("_alias").isNotNull(), "alias").otherwise("default")
    return judged.withColumns({"rule": F.col("_fit.rule"), "verdict": F.coalesce("_fit.verdict", "_alias", F.lit(default)), "via": via}).drop("_id", "_fit", "_alias")
