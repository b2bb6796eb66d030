"""URL filters: block decisions follow redirect and canonical-link edges to aliases.

Every page url is judged by the longest rule that fits (host suffix and path prefix).  Pages
without a rule take the decision of their equivalence class: urls joined by redirect or
canonical-link edges, found as distributed connected components.  A class with a blocked member
blocks its members that no rule allows: an explicit allow on the url itself always holds.

Defined results: a null url or one without ``://`` has an empty host and path, no rule, and the
verdict allow; null html has no edges; repeated pages are judged each; an empty table gives an
empty result; columns beyond page_id, url and html are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, named_components


class UrlRule(NamedTuple):
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (
    UrlRule("allow", "com", "/"), UrlRule("block", "example.com", "/en/"), UrlRule("allow", "www.example.com", "/en/"),
    UrlRule("block", "net", "/es/"), UrlRule("block", "net", "/fr/"),
)


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[UrlRule] = RULES) -> Column:
    """The longest rule that fits, as a struct; rules are tried longest first, equal lengths by name."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def same_page(url: Column) -> Column:
    """What names a page: host and path without scheme, query and fragment."""
    return F.concat(host_of(url), path_of(url))


def resolved(target: Column, base: Column) -> Column:
    """The target as an absolute url; one of a scheme without ``://`` is null."""
    plain = F.regexp_extract(target, r"(?s)^([^?#]*)", 1)
    folder = F.coalesce(F.regexp_extract(path_of(base), r"(?s)^(.*/)", 1), F.lit(""))
    path = F.when(plain.startswith("/"), plain).otherwise(F.concat(F.when(folder == "", "/").otherwise(folder), plain))
    steps = F.split(F.regexp_replace(path, r"(^|/)(\.\.?)$", "$1$2/"), "/")
    up = lambda a: F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(1)))
    kept = F.aggregate(steps, F.array().cast("array<string>"), lambda a, s: F.when(s == ".", a).when(s == "..", up(a)).otherwise(F.concat(a, F.array(s))))
    return (F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://"), target).when(target.startswith("//"), F.concat(F.lit("http:"), target))
            .when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), F.lit(None).cast("string")).when(plain == "", base)
            .otherwise(F.concat(F.lit("http://"), host_of(base), F.array_join(kept, "/"))))


def link_edges(pages: DataFrame) -> DataFrame:
    """(a, b): the page and the target of each canonical link, og:url or meta refresh in its html, resolved against its base."""
    attr = r"""["']?([^"'\s>]+)"""
    tag = lambda mark, name: rf"""(?is)<(?:link|meta)\b(?=[^>]*{mark})[^>]*?{name}{attr}"""
    html = F.coalesce(F.col("html"), F.lit(""))
    targets = F.concat(*[F.regexp_extract_all(html, F.lit(p), F.lit(1)) for p in (
        tag(r"""rel=["']?canonical""", r"href\s*=\s*"), tag(r"""property=["']?og:url""", r"content\s*=\s*"),
        tag(r"""http-equiv=["']?refresh""", r"url\s*=\s*"))])
    linked = pages.where(html.rlike("(?i)canonical|og:url|http-equiv")).where(F.col("url").contains("://"))
    own = F.regexp_extract(html, r"""(?is)<base\b[^>]*?\shref\s*=\s*["']?([^"'\s>]+)""", 1)
    rows = linked.select(F.col("url").alias("_u"), own.alias("_o"), F.explode(targets).alias("_t"))
    rows = rows.withColumn("_o", F.when(F.col("_o") == "", F.col("_u")).otherwise(resolved(F.col("_o"), F.col("_u"))))
    return rows.select(same_page(F.col("_u")).alias("a"), same_page(resolved(F.col("_t"), F.coalesce("_o", "_u"))).alias("b")).where("b != ''")


def filter_urls(pages: DataFrame, redirects: DataFrame | None = None, rules: Sequence[UrlRule] = RULES) -> DataFrame:
    """page_id, host, path, rule and verdict of every page.  redirects: more edges, as urls (src, dst)."""
    edges = link_edges(pages)
    if redirects is not None:
        edges = edges.unionByName(redirects.select(same_page(F.col("src")).alias("a"), same_page(F.col("dst")).alias("b")))
    url = F.col("url")
    judged = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"))
    judged = judged.withColumn("_r", rule_of(F.col("host"), F.col("path"), rules)).withColumn("_key", F.concat("host", "path"))
    root = named_components(edges)
    # A class is blocked if a rule blocks any of its urls, whether or not they are pages here.
    verdict = rule_of(F.substring_index(F.col("node"), "/", 1), F.expr("substring(node, CASE WHEN locate('/', node) = 0 THEN length(node) + 1 ELSE locate('/', node) END)"), rules)["verdict"]
    blocked = root.withColumn("_v", verdict).groupBy("root").agg(F.max((F.col("_v") == "block").cast("int")).alias("_blocked")).where("_blocked = 1")
    bad = root.join(blocked, "root").select(F.col("node").alias("_key"), F.lit(True).alias("_bad"))
    out = judged.join(bad, "_key", "left")
    return out.select("page_id", "host", "path", F.col("_r.rule").alias("rule"),
                      F.coalesce(F.col("_r.verdict"), F.when(F.col("_bad"), F.lit("block")), F.lit("allow")).alias("verdict"))


def oracle_sql() -> str:
    """DuckDB SQL with the rules as a table and the classes as a recursive closure of the edges."""
    rules = ", ".join(f"('{r.verdict}', '{r.host}', '{r.path}')" for r in RULES)
    host = lambda u: rf"""translate(regexp_extract({u}, '^(?s:.*?)://([^/?#]*)', 1), '{UPPER}', '{LOWER}')"""
    path = lambda u: rf"""regexp_extract({u}, '^(?s:.*?)://[^/?#]*([^?#]*)', 1)"""
    return rf"""
WITH RECURSIVE rules(verdict, h, p) AS (VALUES {rules}),
u AS (SELECT page_id, url, html, coalesce({host('url')}, '') AS host, coalesce({path('url')}, '') AS path FROM pages),
tags AS (SELECT host || path AS a, unnest(regexp_extract_all(coalesce(html, ''), '(?is)<(?:link|meta)\b[^>]*>')) AS tag FROM u WHERE contains(url, '://')),
links AS (SELECT a, regexp_extract(tag, '[a-z]+://[^"''\s>]+') AS t FROM tags WHERE regexp_matches(tag, '(?i)rel=["'']?canonical|property=["'']?og:url|http-equiv=["'']?refresh')),
e AS (SELECT a, {host('t')} || {path('t')} AS b FROM links WHERE t <> ''),
pairs AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach(a, b) AS (SELECT a, b FROM pairs UNION SELECT r.a, x.b FROM reach r JOIN pairs x ON r.b = x.a),
judged AS (SELECT u.page_id, u.host, u.path, first(h || p ORDER BY length(h || p) DESC, h || p DESC) AS rule, first(verdict ORDER BY length(h || p) DESC, h || p DESC) AS v
  FROM u LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY ALL),
bad AS (SELECT DISTINCT r.a FROM reach r JOIN judged j ON r.b = j.host || j.path WHERE j.v = 'block')
SELECT page_id, host, path, rule, coalesce(v, CASE WHEN bad.a IS NOT NULL THEN 'block' END, 'allow') AS verdict
FROM judged LEFT JOIN bad ON bad.a = judged.host || judged.path"""
