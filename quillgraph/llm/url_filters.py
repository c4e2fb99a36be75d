"""URL rules that reach aliases: redirect equivalence.

A url without its fragment is a node: host, and path with query. Redirects (a given table) and the canonical and refresh
links of pages are edges; their connected components are found distributedly, and a decision reaches every alias of a
url. A url's own rule comes first (the longest that fits its host and path); without one, an explicit allow in its
component wins over a block there; without either, the url is allowed.

Defined cases: a null url, or one without ``://``, has empty host and path, and such urls share no component
by links; null html has no links; links that aren't absolute are taken relative to the page's host and path, other
schemes (``mailto:``) ignored; repeated rows give repeated results; rules of the same host and path: allow wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, components, materialize, table

RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]


def host_of(url: Column) -> Column:
    rest = F.substr(url, F.instr(url, "://") + 3)
    return F.when(F.contains(url, F.lit("://")), ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0))).otherwise("")


def path_of(url: Column) -> Column:
    rest = F.substr(url, F.instr(url, "://") + 3)
    return F.when(F.contains(url, F.lit("://")), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)).otherwise("")


def tail_of(url: Column) -> Column:
    """Path and query."""
    rest = F.substr(url, F.instr(url, "://") + 3)
    return F.when(F.contains(url, F.lit("://")), F.regexp_extract(rest, r"^[^/?#]*([^#]*)", 1)).otherwise("")


def beside(path: Column, to: Column) -> Column:
    """The path that a reference without a leading slash means on a page of a path, without dot segments; an empty one means the page."""
    steps = F.split(F.concat(F.regexp_replace(F.regexp_replace(path, r"[^/]*$", ""), "^/", ""), to), "/")
    go = lambda kept, x: F.when(x == ".", kept).when(x == "..", F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0)))).otherwise(F.concat(kept, F.array(x)))
    kept = F.aggregate(steps, F.array().cast("array<string>"), go)
    kept = F.when(F.element_at(steps, -1).isin(".", ".."), F.concat(kept, F.array(F.lit("")))).otherwise(kept)
    return F.when(to == "", path).otherwise(F.concat(F.lit("/"), F.array_join(kept, "/")))


def link_edges(pages: DataFrame) -> DataFrame:
    """(from_host, from_tail, to_host, to_tail) by the pages' canonical and refresh links."""
    tag = r"(?is)<(?:link\b(?=[^>]*\brel\s*=\s*(?:[\"']\s*(?:[^\"'>\s]+\s+)*)?canonical\b)|meta\b(?=[^>]*http-equiv\s*=\s*[\"']?refresh\b))[^>]*>"
    href = r"(?is)(?:\bhref\s*=\s*|;\s*url\s*=\s*)[\"']?\s*([^\"'>\s]+)"
    found = pages.where(F.contains(F.lower("html"), F.lit("canonical")) | F.contains(F.lower("html"), F.lit("refresh")))
    found = found.select(host_of(F.col("url")).alias("from_host"), path_of(F.col("url")).alias("from_path"), tail_of(F.col("url")).alias("from_tail"), F.explode(F.regexp_extract_all("html", F.lit(tag), F.lit(0))).alias("tag"))
    found = found.withColumn("to", F.replace(F.regexp_extract("tag", href, 1), F.lit("&amp;"), F.lit("&")))
    at = F.concat(F.lit("http://"), F.col("from_host"))
    to = (
        F.when(F.col("to").rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), F.col("to")).when(F.col("to").rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:") | (F.col("to") == ""), None)
        .when(F.startswith("to", F.lit("//")), F.concat(F.lit("http:"), F.col("to"))).when(F.startswith("to", F.lit("/")), F.concat(at, F.col("to")))
        .when(F.startswith("to", F.lit("#")), F.concat(at, F.col("from_tail")))
        .otherwise(F.concat(at, beside(F.col("from_path"), F.regexp_extract("to", r"^[^?#]*", 0)), F.regexp_extract("to", r"^[^?#]*([^#]*)", 1)))
    )
    found = found.withColumn("to", to).where("to is not null and from_host <> ''")
    return found.select("from_host", "from_tail", host_of(F.col("to")).alias("to_host"), tail_of(F.col("to")).alias("to_tail"))


def url_edges(redirects: DataFrame) -> DataFrame:
    """The same of a table of redirects (from_url, to_url)."""
    return redirects.select(host_of(F.col("from_url")).alias("from_host"), tail_of(F.col("from_url")).alias("from_tail"), host_of(F.col("to_url")).alias("to_host"), tail_of(F.col("to_url")).alias("to_tail"))


def own_rules(nodes: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, path, rule, own): the longest rule that fits each distinct node(host, path), null without one.

    A host joins the rules of its suffixes, a few rows for each node, whatever the number of rules.
    """
    parts = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    at = nodes.withColumn("suffix", F.explode(F.array_distinct(suffixes)))
    fit = at.join(rules, F.col("suffix") == F.col("rule_host")).where(F.startswith("path", F.col("rule_path")))
    length = F.length("rule_host") + F.length("rule_path")
    best = F.max_by(F.struct(F.concat("rule_host", "rule_path").alias("rule"), F.col("verdict").alias("own")), F.struct(length, F.col("verdict") == "allow", F.col("rule_host")))
    return fit.groupBy("host", "path").agg(best.alias("r")).select("host", "path", "r.rule", "r.own")


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, redirects: DataFrame | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every page."""
    spark = pages.sparkSession
    rule_table = spark.createDataFrame(rules, "verdict string, rule_host string, rule_path string")
    edges = link_edges(pages)
    if redirects is not None:
        edges = edges.unionByName(url_edges(redirects))
    # the length of the host tells where it ends, whatever is in it
    node = lambda p: F.concat(F.length(f"{p}host").cast("string"), F.lit(":"), F.col(f"{p}host"), F.col(f"{p}tail"))
    linked = components(edges.where("from_host <> '' and to_host <> ''").select(node("from_").alias("a"), node("to_").alias("b")))
    located = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), tail_of(F.col("url")).alias("tail"))
    size, rest = F.substring_index("id", ":", 1).cast("int"), F.substr("id", F.instr("id", ":") + 1)
    apart = linked.select("id", F.substr(rest, F.lit(1), size).alias("host"), F.regexp_extract(F.substr(rest, size + 1), r"^[^?]*", 0).alias("path"), "comp")
    nodes = located.select("host", "path").union(apart.select("host", "path")).distinct()
    own = materialize(own_rules(nodes, rule_table), "url-rules")
    votes = apart.join(own, ["host", "path"]).groupBy("comp").agg(F.max(F.col("own") == "allow").alias("allows"))
    told = apart.join(votes, "comp").select("id", F.when(F.col("allows"), "allow").otherwise("block").alias("told"))
    out = located.join(own, ["host", "path"], "left").withColumn("id", node("")).join(told, "id", "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("own", "told", F.lit("allow")).alias("verdict"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


OP8_SQL = r"""
WITH RECURSIVE u AS (
  SELECT page_id, html, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, html, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, regexp_extract(rest, '^[^/?#]*([^#]*)', 1) AS tail FROM u),
rules(own, rh, rp) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
t AS (SELECT host, path, tail, unnest(regexp_extract_all(html, '(?is)<(?:link|meta)\b[^>]*>')) AS tag FROM p WHERE host <> ''),
l AS (SELECT host, path, tail, replace(regexp_extract(tag, '(?is)(?:\bhref\s*=\s*|;\s*url\s*=\s*)["'']?\s*([^"''>\s]+)', 1), '&amp;', '&') AS link FROM t
      WHERE regexp_matches(tag, '(?is)^<link.*\brel\s*=\s*(?:["'']\s*(?:[^"''>\s]+\s+)*)?canonical\b') OR regexp_matches(tag, '(?is)^<meta.*http-equiv\s*=\s*["'']?refresh\b')),
g AS (SELECT *, string_split(regexp_replace(regexp_replace(path, '[^/]*$', ''), '^/', '') || regexp_extract(link, '^[^?#]*', 0), '/') AS steps FROM l WHERE link <> ''),
k AS (SELECT *, list_reduce(list_transform(steps, lambda z: [z]), lambda y, z: CASE WHEN z[1] = '.' THEN y WHEN z[1] = '..' THEN y[:-2] ELSE y || z END, []::VARCHAR[])
        || CASE WHEN steps[-1] IN ('.', '..') THEN [''] ELSE [] END AS kept FROM g),
a AS (SELECT host, path, tail, CASE WHEN regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN substr(link, instr(link, '://') + 3) WHEN regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN NULL
        WHEN starts_with(link, '//') THEN substr(link, 3) WHEN starts_with(link, '/') THEN host || link
        WHEN starts_with(link, '#') THEN host || tail
        ELSE host || CASE WHEN regexp_extract(link, '^[^?#]*', 0) = '' THEN path ELSE '/' || array_to_string(kept, '/') END || regexp_extract(link, '^[^?#]*([^#]*)', 1) END AS rest FROM k),
z AS (SELECT host, path, tail, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS h2, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS p2, regexp_extract(rest, '^[^/?#]*([^#]*)', 1) AS t2
      FROM a WHERE rest IS NOT NULL),
e AS (SELECT length(host) || ':' || host || tail AS x, length(h2) || ':' || h2 || t2 AS y, host, path, h2, p2 FROM z WHERE h2 <> ''),
b AS (SELECT x, y FROM e UNION SELECT y, x FROM e),
reach(x, y) AS (SELECT x, y FROM b UNION SELECT r.x, b.y FROM reach r JOIN b ON r.y = b.x),
n AS (SELECT host, path FROM p UNION SELECT host, path FROM e UNION SELECT h2, p2 FROM e),
f AS (SELECT host, path, rh || rp AS rule, own, row_number() OVER (PARTITION BY host, path ORDER BY length(rh) + length(rp) DESC) AS k
      FROM n JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)),
o AS (SELECT host, path, rule, own FROM f WHERE k = 1),
s AS (SELECT x AS id, host, path FROM e UNION SELECT y, h2, p2 FROM e),
v AS (SELECT reach.x, max((own = 'allow')::INT) AS allows FROM reach JOIN s ON reach.y = s.id JOIN o ON s.host = o.host AND s.path = o.path GROUP BY reach.x)
SELECT page_id, p.host, p.path, o.rule, coalesce(o.own, CASE WHEN allows = 1 THEN 'allow' WHEN allows = 0 THEN 'block' END, 'allow') AS verdict
FROM p LEFT JOIN o ON p.host = o.host AND p.path = o.path LEFT JOIN v ON v.x = length(p.host) || ':' || p.host || p.tail
"""
