"""URL block and allow rules, carried over redirects and canonical links.

A rule judges the urls it fits. Pages that redirect to, or name as canonical, one another are aliases;
the connected components over these links are the classes. A url without a rule of its own takes the verdict of
its class: allow if any member is explicitly allowed, else block if any is blocked, else allow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, stored

# Verdict, host and path of each rule.
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)
#: Where a page names another address of itself.
_CANONICAL = r"""(?is)<link\b[^>]*?\brel\s*=\s*["']?canonical\b[^>]*>"""
_REFRESH = r"""(?is)<meta\b[^>]*?\bhttp-equiv\s*=\s*["']?refresh\b[^>]*>"""
_HREF = r"""(?is)\bhref\s*=\s*["']?([^"'\s>]+)"""
_URL = r"""(?is)\burl\s*=\s*["']?([^"'\s>;]+)"""


def host(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty without ://."""
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path(url: Column) -> Column:
    """After the host up to ? # or the end; empty without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def best_rule(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits the host or a parent of it and begins the path; else null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, at, start in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r[1], r[2])):  # longer ones are asked first
        fits = ((host == at) | host.endswith("." + at)) & path.startswith(start)
        out = F.when(fits, F.struct(F.lit(at + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def address(url: Column) -> Column:
    """What two spellings of an address share: scheme and fragment do not matter; null without ://."""
    rest = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1)
    return F.when(F.instr(url, "://") > 0, F.concat(host(url), F.when(F.startswith(rest, F.lit("/")), rest).otherwise(F.concat(F.lit("/"), rest))))


def links(pages: DataFrame, url: str = "url", html: str = "html", redirects: DataFrame | None = None) -> DataFrame:
    """Alias links (a, b) of addresses: canonical links and refreshes of the pages, and `redirects`(source, target).

    Targets without a host are taken relative to the page's host.
    """
    body = F.col(html)
    named = pages.select(
        F.col(url).alias("_u"),
        F.explode(F.array(
            F.regexp_extract(F.regexp_extract(body, _CANONICAL, 0), _HREF, 1),
            F.regexp_extract(F.regexp_extract(body, _REFRESH, 0), _URL, 1),
        )).alias("_to"),
    ).where("_to != ''")
    scheme = F.regexp_extract("_u", r"(?s)^(.*?://)", 1)
    target = (
        F.when(F.instr("_to", "://") > 0, F.col("_to"))
        .when(F.startswith("_to", F.lit("//")), F.concat(F.lit("http:"), "_to"))
        .when(F.startswith("_to", F.lit("/")), F.concat(scheme, host(F.col("_u")), "_to"))
        .otherwise(F.concat(scheme, host(F.col("_u")), F.regexp_extract(path(F.col("_u")), r"(?s)^(.*/)", 1), "_to"))
    )
    out = named.select(address(F.col("_u")).alias("a"), address(target).alias("b"))
    if redirects is not None:
        out = out.union(redirects.select(address(F.col("source")).alias("a"), address(F.col("target")).alias("b")))
    return out.where("a != b").distinct()


def judge(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", rules=RULES,
          redirects: DataFrame | None = None) -> DataFrame:
    """key, host, path, rule, verdict, alias_class of every row of `pages`.

    Null urls and urls without :// have empty host and path, no rule, no aliases, and are allowed. Null html
    names no link. Repeated rows repeat, null keys stay, other columns are ignored; classes are the
    64-bit digest of their smallest digest's address (null for an address without alias).
    """
    u = F.col(url)
    named = stored(links(pages, url, html, redirects))
    # nodes are 64-bit digests of addresses, so that the components carry numbers
    classes = stored(components(named.select(F.xxhash64("a").alias("a"), F.xxhash64("b").alias("b"))))
    judged = pages.select(F.col(key), host(u).alias("host"), path(u).alias("path"), F.xxhash64(address(u)).alias("_node"), address(u).isNotNull().alias("_known")).withColumn(
        "_rule", best_rule(F.col("host"), F.col("path"), rules)
    )
    placed = judged.join(classes.withColumnRenamed("node", "_node").withColumnRenamed("component", "alias_class"), "_node", "left")
    # link targets that are no page count as members too
    ends = named.select("a").union(named.select("b")).distinct()
    outside = ends.select(F.xxhash64("a").alias("node"), best_rule(F.regexp_extract("a", "^[^/?#]*", 0), F.regexp_extract("a", r"(?s)^[^/?#]*([^?#]*)", 1), rules)["verdict"].alias("v"))
    inside = judged.select(F.col("_node").alias("node"), F.col("_rule.verdict").alias("v"))
    ruled = outside.union(inside.where("v is not null")).where("v is not null").join(classes, "node").groupBy("component").agg(
        F.max((F.col("v") == "allow").cast("int")).alias("_allowed"), F.max((F.col("v") == "block").cast("int")).alias("_blocked")
    )
    carried = F.when(F.col("_allowed") == 1, "allow").when(F.col("_blocked") == 1, "block").otherwise("allow")
    return placed.join(ruled.withColumnRenamed("component", "alias_class"), "alias_class", "left").select(
        key, "host", "path", F.col("_rule.rule").alias("rule"), F.coalesce(F.col("_rule.verdict"), carried).alias("verdict"),
        F.when(F.col("_known"), F.col("alias_class")).alias("alias_class"),
    )
