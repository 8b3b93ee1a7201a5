"""URL filter whose block decisions follow redirects and canonical links.

1. Host and path are cut from the url; a rule (host, path, action) fits its host and all
   subdomains when the url's path starts with the rule's; the longest rule wins (equal length:
   allow before block, then the smaller rule text).
2. Urls that differ in scheme, fragment or a tracking parameter only are one alias node. Redirects
   (a table, or a page's refresh target) and canonical links are edges between nodes; aliases are
   the connected components of these edges, found by a distributed algorithm.
3. A page without a rule of its own takes the decision of its component: allow where any member is
   explicitly allowed, else block where any member is blocked, else allow.

Defined results: a null url, or one without ``://``, has an empty host and path, no rule, no
alias, and is allowed. A null html has no links. Repeated rows are judged alike and all returned.
Other columns are ignored, whatever their names. An empty table gives an empty result. Everything is
built from DataFrame functions; a component of any size is only ever aggregated and joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stopwise.llm.graph import components

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Query parameters that don't change what a url names.
TRACKING = r"(?:utm_[a-z]+|ref|gclid|fbclid)"
ATTRIBUTE = r"""\s*=\s*["']?([^"'>\s]+)"""
CANONICAL = (
    r"""(?i)<link\b[^>]*\brel\s*=\s*["']?canonical\b[^>]*\bhref""" + ATTRIBUTE,
    r"""(?i)<link\b[^>]*\bhref""" + ATTRIBUTE + r"""[^>]*\brel\s*=\s*["']?canonical\b""",
)
REFRESH = r"""(?i)<meta\b[^>]*\bhttp-equiv\s*=\s*["']?refresh\b[^>]*\bcontent\s*=\s*["']?[^"'>]*?url\s*=\s*([^"'>\s]+)"""


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def _rest(url: Column) -> Column:
    """What follows the first ``://``; empty when there is none."""
    at = F.instr(url, "://")
    return F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    return lower_ascii(F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def alias_of(url: Column) -> Column:
    """Node of a url: host, path, and the query without tracking parameters; null when there is no host."""
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    kept = F.array_join(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(f"^{TRACKING}(=|$)")), "&")
    path = F.when(path_of(url) == "", "/").otherwise(path_of(url))
    node = F.concat(host_of(url), path, F.when(kept == "", "").otherwise(F.concat(F.lit("?"), kept)))
    return F.when(host_of(url) != "", node)


def _absolute(target: Column, url: Column) -> Column:
    """A link target as a url; a bare relative path is taken below the page's folder."""
    scheme = F.regexp_extract(url, r"^(.*?)://", 1)
    site = F.concat(scheme, F.lit("://"), host_of(url))
    folder = F.regexp_extract(path_of(url), r"^(?:.*/)?", 0)
    return (
        F.when(target == "", F.lit(None))
        .when(target.contains("://"), target)
        .when(target.startswith("//"), F.concat(scheme, F.lit(":"), target))
        .when(target.startswith("/"), F.concat(site, target))
        .otherwise(F.concat(site, F.when(folder == "", "/").otherwise(folder), target))
    )


def page_edges(pages: DataFrame) -> DataFrame:
    """Alias edges ``a, b`` that the pages themselves declare."""
    url, html = F.col("url"), F.col("html")
    targets = [F.regexp_extract(html, pattern, 1) for pattern in (*CANONICAL, REFRESH)]
    declared = pages.select("url", F.explode(F.array(*targets)).alias("target")).where("target != ''")
    return declared.select(alias_of(url).alias("a"), alias_of(_absolute(F.replace("target", F.lit("&amp;"), F.lit("&")), url)).alias("b"))


def match_rules(sites: DataFrame, rules: DataFrame) -> DataFrame:
    """``host, path, rule, action`` of the sites that a rule fits; sites are distinct (host, path)."""
    parts = F.split("host", r"\.")
    tails = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    candidates = sites.select("host", "path", F.explode(F.array_distinct(tails)).alias("rule_host"))
    fits = candidates.join(rules.distinct(), "rule_host").where(F.startswith("path", "rule_path"))
    rule = F.concat("rule_host", "rule_path")
    order = F.struct(-F.length(rule), F.col("action"), rule.alias("rule"))
    best = fits.groupBy("host", "path").agg(F.min(order).alias("best"))
    return best.select("host", "path", "best.rule", "best.action")


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] | DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """``page_id, host, path, rule, verdict`` of every row of ``pages`` (page_id, url, html).

    rules: (host, path, action) with action allow or block; a list or a table of any size.
    redirects: further alias edges, as urls in columns ``src`` and ``dst``.
    """
    spark = pages.sparkSession
    if not isinstance(rules, DataFrame):
        rules = spark.createDataFrame(rules, "rule_host string, rule_path string, action string")
    edges = page_edges(pages)
    if redirects is not None:
        edges = edges.union(redirects.select(alias_of(F.col("src")), alias_of(F.col("dst"))))
    aliases = components(edges).select(F.col("node").alias("alias"), F.col("root"))
    url = F.col("url")
    parsed = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), alias_of(url).alias("alias"))
    matched = match_rules(parsed.select("host", "path").distinct(), rules)
    own = parsed.join(matched, ["host", "path"], "left").join(aliases, "alias", "left")
    own = own.withColumn("group", F.coalesce("root", "alias"))
    # a component's decision: allow sorts before block
    decided = own.where("action IS NOT NULL AND group IS NOT NULL").groupBy("group").agg(F.min("action").alias("spread"))
    verdict = F.coalesce("action", "spread", F.lit("allow")).alias("verdict")
    return own.join(decided, "group", "left").select("page_id", "host", "path", "rule", verdict)
