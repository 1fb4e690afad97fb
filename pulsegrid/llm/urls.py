"""URL rules with redirect equivalence, in DataFrame functions only.

A url's own rule decides first (the longest that fits). A url that no rule fits takes the verdict of its alias
class: the connected component over canonical links and redirects (every link rel=canonical and meta refresh outside
comments and scripts, and an optional table of redirects). Addresses relative to the page (with //, /, ?, ., .. or a bare
name) are resolved, character references of ASCII punctuation decoded; other schemes (mailto:) are no links. In a class an
explicit allow, of any page or link target in it, comes before a block; a class without either is allowed.

Defined cases: a null url, or one without ://, has empty host and path, no rule and is allowed; null html has no
links; repeated rows return as often as they stand; ties between rules of one length go to allow; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import connected_components, cut

#: Fixed values: (verdict, host and path) as the contract states them.
RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SKIPPED = r"(?is)<!--.*?-->|<script\b.*?</script\s*>"
TAG = r"(?is)<(?:link|meta)\b[^>]*>"
CANONICAL = r"""(?is)^<link\b.*\brel\s*=\s*["']?canonical\b"""
REFRESH = r"""(?is)^<meta\b.*\bhttp-equiv\s*=\s*["']?refresh\b"""
HREF = r"""(?is)\bhref\s*=\s*["']?([^"'\s>]+)"""
TARGET = r"""(?is)\burl\s*=\s*["']?([^"'\s>]+)"""
#: Character references that stand in addresses.
REFERENCES = [("&(?:amp|#38|#x26);?", "&"), ("&(?:#47|#x2f|sol);?", "/"), ("&(?:#61|#x3d|equals);?", "="), ("&(?:#63|#x3f|quest);?", "?"), ("&(?:#58|#x3a|colon);?", ":"), ("&(?:#46|#x2e|period);?", ".")]


def host_of(url: Column) -> Column:
    rest = _rest(url)
    return F.translate(F.coalesce(F.regexp_extract(rest, r"^([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, or null."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[0] == "allow")):
        h, slash, p = rule.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(slash + p)
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def node_of(url: Column) -> Column:
    """One name for spellings of one address: no scheme, fragment or end slash, host in lower case, no tracking parameters."""
    query = F.regexp_replace(F.regexp_extract(url, r"\?([^#]*)", 1), r"(?:^|&)(?:utm_\w+|ref|fbclid|gclid)=[^&]*", "")
    query = F.regexp_replace(query, r"^&", "")
    bare = F.concat(host_of(url), F.regexp_replace(path_of(url), r"/+$", ""))
    return F.when(F.instr(url, "://") > 0, F.when(query == "", bare).otherwise(F.concat(bare, F.lit("?"), query)))


def links_of(html: Column) -> Column:
    """The canonical and refresh targets of a page, as written but for character references."""
    tags = F.regexp_extract_all(F.regexp_replace(html, SKIPPED, ""), F.lit(TAG), F.lit(0))
    found = F.transform(tags, lambda t: F.when(t.rlike(CANONICAL), F.regexp_extract(t, HREF, 1)).when(t.rlike(REFRESH), F.regexp_extract(t, TARGET, 1)).otherwise(""))

    def decoded(u: Column) -> Column:
        for pattern, char in REFERENCES:
            u = F.regexp_replace(u, "(?i)" + pattern, char)
        return u

    return F.when(html.rlike("(?i)canonical|refresh"), F.transform(F.filter(found, lambda u: u != ""), decoded))


def resolved(src: Column, dst: Column) -> Column:
    """The address of dst on the page src, or null if it is no link."""
    top = F.concat(F.lit("http://"), host_of(src))
    path = F.when(dst.startswith("/"), dst).otherwise(F.concat(F.coalesce(F.nullif(F.regexp_extract(path_of(src), r"^.*/", 0), F.lit("")), F.lit("/")), dst))
    bare, tail = F.regexp_extract(path, r"^[^?#]*", 0), F.regexp_extract(path, r"^[^?#]*(.*)$", 1)
    parts = F.filter(F.split(F.substring(bare, 2, 1 << 30), "/"), lambda x: x != ".")
    walked = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, x: F.when(x != "..", F.concat(acc, F.array(x))).otherwise(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))))
    whole = F.concat(top, F.lit("/"), F.array_join(walked, "/"), tail)
    return (
        F.when(dst.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*://"), dst)
        .when(dst.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:") | dst.startswith("#"), None)
        .when(dst.startswith("//"), F.concat(F.lit("http:"), dst))
        .when(dst.startswith("?"), F.concat(top, path_of(src), dst))
        .otherwise(whole)
    )


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]] = RULES, redirects: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict of each page. redirects: optional (src, dst) urls."""
    p = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), links_of(F.col("html")).alias("links"))
    p = p.withColumn("hit", rule_of(F.col("host"), F.col("path"), rules)).withColumn("node", node_of(F.col("url")))
    p = cut(p, "urls")
    e = p.where("links is not null and node is not null").select(F.col("url").alias("src"), F.explode("links").alias("dst"))
    if redirects is not None:
        e = e.union(redirects.select("src", "dst"))
    e = e.select("src", resolved(F.col("src"), F.col("dst")).alias("dst")).where("src is not null and dst is not null")
    e = cut(e.select("src", "dst", node_of(F.col("src")).alias("a"), node_of(F.col("dst")).alias("b")).where("a is not null and b is not null"), "links")
    parts = connected_components(e.select("a", "b"))
    named = e.select(F.col("a").alias("node"), F.col("src").alias("url")).union(e.select(F.col("b").alias("node"), F.col("dst").alias("url")))
    named = named.select("node", rule_of(host_of(F.col("url")), path_of(F.col("url")), rules)["verdict"].alias("v"))
    named = named.union(p.where("hit is not null and node is not null").select("node", "hit.verdict")).groupBy("node").agg(F.max((F.col("v") == "allow").cast("int")).alias("allow"), F.max((F.col("v") == "block").cast("int")).alias("block"))
    member = parts.join(named, "node")
    whole = member.groupBy("component").agg(F.max("allow").alias("allow"), F.max("block").alias("block"))
    alias = parts.join(whole, "component").select("node", F.when(F.coalesce("allow", F.lit(0)) == 1, "allow").when(F.col("block") == 1, "block").otherwise("allow").alias("alias_verdict"))
    open_ = F.col("hit").isNull() & F.col("node").isNotNull()
    joined = p.where(open_).join(alias, "node", "left").select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.coalesce("alias_verdict", F.lit("allow")).alias("verdict"))
    return p.where(~open_).select("page_id", "host", "path", F.col("hit.rule").alias("rule"), F.coalesce("hit.verdict", F.lit("allow")).alias("verdict")).union(joined)


def urls_query(spark, sf_dir: str) -> DataFrame:
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))


ORACLE = r"""
WITH RECURSIVE page AS (SELECT row_number() OVER () AS rid, page_id, url, html FROM pages),
tag AS (SELECT url AS src, unnest(regexp_extract_all(regexp_replace(html, '(?is)<!--.*?-->|<script\b.*?</script\s*>', '', 'g'), '(?is)<(?:link|meta)\b[^>]*>')) AS t
  FROM page WHERE regexp_matches(html, '(?i)canonical|refresh') AND strpos(url, '://') > 0),
raw AS (SELECT src, CASE WHEN regexp_matches(t, '(?is)^<link\b.*\brel\s*=\s*["'']?canonical\b') THEN regexp_extract(t, '(?is)\bhref\s*=\s*["'']?([^"''\s>]+)', 1)
    WHEN regexp_matches(t, '(?is)^<meta\b.*\bhttp-equiv\s*=\s*["'']?refresh\b') THEN regexp_extract(t, '(?is)\burl\s*=\s*["'']?([^"''\s>]+)', 1) ELSE '' END AS r FROM tag),
dec AS (SELECT src, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(r, '(?i)&(?:amp|#38|#x26);?', '&', 'g'), '(?i)&(?:#47|#x2f|sol);?', '/', 'g'),
  '(?i)&(?:#61|#x3d|equals);?', '=', 'g'), '(?i)&(?:#63|#x3f|quest);?', '?', 'g'), '(?i)&(?:#58|#x3a|colon);?', ':', 'g'), '(?i)&(?:#46|#x2e|period);?', '.', 'g') AS d FROM raw WHERE r <> ''),
split AS (SELECT src, d, substr(src, strpos(src, '://') + 3) AS rest FROM dec),
based AS (SELECT src, d, regexp_extract(rest, '^([^/?#]*)', 1) AS h, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS p FROM split),
aimed AS (SELECT src, CASE WHEN regexp_matches(d, '^[a-zA-Z][a-zA-Z0-9+.-]*://') THEN d WHEN regexp_matches(d, '^[a-zA-Z][a-zA-Z0-9+.-]*:') OR starts_with(d, '#') THEN NULL
  WHEN starts_with(d, '//') THEN 'http:' || d WHEN starts_with(d, '?') THEN 'http://' || h || p || d END AS whole,
  CASE WHEN NOT (regexp_matches(d, '^[a-zA-Z][a-zA-Z0-9+.-]*:') OR d[1] IN ('#', '?') OR starts_with(d, '//'))
    THEN 'http://' || h END AS top, CASE WHEN starts_with(d, '/') THEN d ELSE coalesce(nullif(regexp_extract(p, '^.*/'), ''), '/') || d END AS path FROM based),
dots(src, top, path, tail) AS (
  SELECT src, top, regexp_replace(regexp_extract(path, '^[^?#]*'), '/\.(?:/\.)*(/|$)', '/', 'g'), regexp_extract(path, '^[^?#]*(.*)$', 1) FROM aimed WHERE top IS NOT NULL
  UNION SELECT src, top, CASE WHEN regexp_matches(path, '^/\.\.(/|$)') THEN regexp_replace(path, '^/\.\.(/|$)', '/') ELSE regexp_replace(path, '/[^/]+/\.\.(/|$)', '/') END, tail FROM dots WHERE regexp_matches(path, '/\.\.(/|$)')),
link AS (SELECT src, whole AS dst FROM aimed WHERE whole IS NOT NULL UNION SELECT src, top || path || tail FROM dots WHERE NOT regexp_matches(path, '/\.\.(/|$)')),
said AS (SELECT url FROM page WHERE strpos(url, '://') > 0 UNION SELECT dst FROM link WHERE strpos(dst, '://') > 0),
cutup AS (SELECT url, substr(url, strpos(url, '://') + 3) AS rest, regexp_replace(regexp_replace(regexp_extract(url, '\?([^#]*)', 1), '(?:^|&)(?:utm_\w+|ref|fbclid|gclid)=[^&]*', '', 'g'), '^&', '') AS q FROM said),
hp AS (SELECT url, q, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cutup),
r(verdict, rule, rhost, rpath) AS (VALUES ('block', 'net/', 'net', '/'), ('allow', 'example.net/en/', 'example.net', '/en/'),
  ('block', 'example.com/de/', 'example.com', '/de/'), ('allow', 'org/fr/', 'org', '/fr/')),
best AS (SELECT url, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict FROM hp JOIN r ON (host = rhost OR host LIKE '%.' || rhost) AND starts_with(path, rpath) GROUP BY url),
named AS (SELECT url, host, path, rule, verdict, host || regexp_replace(path, '/+$', '') || CASE WHEN q = '' THEN '' ELSE '?' || q END AS node FROM hp LEFT JOIN best USING (url)),
edge AS (SELECT DISTINCT x.node AS a, y.node AS b FROM link JOIN named x ON x.url = src JOIN named y ON y.url = dst),
ways AS (SELECT a, b FROM edge UNION SELECT b, a FROM edge),
reach(a, b) AS (SELECT a, a FROM ways UNION SELECT reach.a, ways.b FROM reach JOIN ways ON reach.b = ways.a),
class AS (SELECT reach.a AS node, bool_or(verdict = 'allow') AS allow, bool_or(verdict = 'block') AS block FROM reach JOIN named ON named.node = reach.b GROUP BY reach.a)
SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, rule, coalesce(verdict, CASE WHEN coalesce(allow, false) THEN 'allow' WHEN coalesce(block, false) THEN 'block' ELSE 'allow' END) AS verdict
FROM page LEFT JOIN named USING (url) LEFT JOIN class USING (node)
"""
