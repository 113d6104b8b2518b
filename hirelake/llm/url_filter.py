"""URL filters that see through redirects and canonical links.

A rule has a host and the beginning of a path; it fits its host and all
subdomains.  The longest rule that fits a url decides.  A url that no rule fits
takes the decision of its aliases: urls connected to it by redirects (refresh
tags, or given edges) and canonical links, in any number of steps.  Among
aliases an explicit allow goes before any block; without either the url is
allowed.

Urls are one node if host, path and query agree; scheme and fragment do not
count.  Nodes are 64-bit digests.  Rules are met by an equality join on the
suffixes of a host, so that lists of any length can be used.

Defined results: a null url and one without ``://`` have an empty host and path,
fit no rule and have no alias; null html has no links; repeated pages are each
judged; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from hirelake.llm.common import settle
from hirelake.llm.components import components
from hirelake.llm.registry import query, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Host, path and verdict of each rule.
RULES = (
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
)

# Tags that may name another url of the page; an unclosed tag ends at the next.
TAGS = r"(?i)<(?:link|meta)\b[^<>]*>"
CANONICAL = r"(?i)\brel\s*=\s*[\"']?canonical\b"
HREF = r"(?i)\bhref\s*=\s*(?:\"([^\"<>]*)\"|'([^'<>]*)'|([^\s\"'<>]+))"
REFRESH = r"(?i)\bhttp-equiv\s*=\s*[\"']?refresh\b"
REFRESH_URL = r"(?i)\burl\s*=\s*['\"]?([^\s\"'<>]+)"


def parts(url: Column) -> dict[str, Column]:
    """Host, path and query (with its question mark) of a url."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    authority = F.regexp_extract(rest, r"^[^/?#]*", 0)
    after = F.substring(rest, F.length(authority) + 1, F.length(rest))
    return {
        "host": F.translate(authority, UPPER, LOWER),
        "path": F.regexp_extract(after, r"^[^?#]*", 0),
        "query": F.regexp_extract(after, r"^[^?#]*(\?[^#]*)?", 1),
    }


def _placed(df: DataFrame, url: str) -> DataFrame:
    """With host, path and the node of the url (null if it has no host)."""
    found = df.withColumn(url, F.coalesce(F.col(url), F.lit(""))).withColumns(parts(F.col(url)))
    node = F.when(F.col("host") != "", F.xxhash64("host", F.when(F.col("path") == "", "/").otherwise(F.col("path")), "query"))
    return found.withColumn("node", node).drop("query")


def _targets(html: Column) -> Column:
    """The urls that a page names as itself, as they are written."""
    tags = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(TAGS), F.lit(0))
    quoted = lambda t: F.concat(*[F.regexp_extract(t, HREF, i) for i in (1, 2, 3)])
    named = F.transform(
        tags,
        lambda t: F.when(t.rlike(CANONICAL), quoted(t)).when(t.rlike(REFRESH), F.regexp_extract(t, REFRESH_URL, 1)).otherwise(F.lit("")),
    )
    return F.filter(named, lambda u: u != "")


def _absolute(target: str, url: str, host: str, path: str) -> Column:
    """A target as seen from its page."""
    to, scheme = F.col(target), F.regexp_extract(F.col(url), r"^[^:/?#]*", 0)
    home = F.concat(scheme, F.lit("://"), F.col(host))
    folder = F.regexp_extract(F.col(path), r"^(.*)/[^/]*$", 1)
    return (
        F.when(to.contains("://"), to)
        .when(to.startswith("//"), F.concat(scheme, F.lit(":"), to))
        .when(to.startswith("/"), F.concat(home, to))
        .otherwise(F.concat(home, folder, F.lit("/"), to))
    )


def judge(sites: DataFrame, rules: DataFrame) -> DataFrame:
    """The longest rule that fits each distinct (host, path): rule and verdict
    (equally long ones: the one that sorts first)."""
    labels = F.split("host", r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
    )
    listed = rules.select(F.col("host").alias("on"), F.col("path").alias("begins"), "verdict")
    exploded = sites.select("host", "path").where("host <> ''").distinct().withColumn("on", F.explode(suffixes))
    fits = exploded.join(listed, "on").where(F.col("path").startswith(F.col("begins")))
    rule = F.concat("on", "begins")
    best = F.min(F.struct((-F.length(rule)).alias("short"), rule.alias("rule"), "verdict")).alias("best")
    return fits.groupBy("host", "path").agg(best).select("host", "path", "best.rule", "best.verdict")


def filter_urls(pages: DataFrame, rules: DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict and reason (rule, alias or none) of
    every page.  ``redirects`` has further edges: two columns of urls."""
    known = settle(
        _placed(pages.select("page_id", "url", _targets(F.col("html")).alias("targets")), "url")
    )
    links = known.where("node is not null").select("node", "url", "host", "path", F.explode("targets").alias("target"))
    links = links.select(F.col("node").alias("from"), _absolute("target", "url", "host", "path").alias("target"))
    links = _placed(links, "target").where("node is not null").select("from", "node", "host", "path")
    places = known.select("node", "host", "path").union(links.select("node", "host", "path"))
    edges = links.select("from", "node")
    if redirects is not None:
        a, b = redirects.columns
        left = _placed(redirects.select(F.col(a).alias("u"), F.col(b).alias("v")), "u")
        left = left.select(F.col("node").alias("from"), F.col("host").alias("h"), F.col("path").alias("p"), "v")
        given = _placed(left, "v").where("`from` is not null and node is not null")
        edges = edges.union(given.select("from", "node"))
        places = places.union(given.select("node", "host", "path")).union(given.select("from", "h", "p"))
    judged = settle(judge(places, rules))
    joined = components(edges)
    ruled = places.join(judged, ["host", "path"]).join(joined, "node").select("component", "verdict")
    decided = ruled.groupBy("component").agg(F.min("verdict").alias("alias"))  # allow sorts before block
    aliases = joined.join(decided, "component").select("node", "alias")
    out = known.join(judged, ["host", "path"], "left").join(aliases, "node", "left")
    return out.select(
        "page_id",
        "host",
        "path",
        "rule",
        F.coalesce("verdict", "alias", F.lit("allow")).alias("verdict"),
        F.when(F.col("verdict").isNotNull(), "rule").when(F.col("alias").isNotNull(), "alias").otherwise("none").alias("reason"),
    )


def _sql() -> str:
    """The same rows with aliases by plain recursion."""
    rules = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
    rest = "CASE WHEN strpos({0}, '://') > 0 THEN substr({0}, strpos({0}, '://') + 3) ELSE '' END"

    def split(source: str, keep: str, url: str) -> str:
        return f"""(SELECT {keep}, translate(a, '{UPPER}', '{LOWER}') AS host,
          regexp_extract(substr(r, length(a) + 1), '^[^?#]*') AS path,
          translate(a, '{UPPER}', '{LOWER}') || ' ' ||
            coalesce(nullif(regexp_extract(substr(r, length(a) + 1), '^[^?#]*'), ''), '/') || ' ' ||
            regexp_extract(substr(r, length(a) + 1), '^[^?#]*(\\?[^#]*)?', 1) AS node
          FROM (SELECT *, regexp_extract(r, '^[^/?#]*') AS a FROM (SELECT *, {rest.format(url)} AS r FROM {source})))"""

    def q(pattern: str) -> str:
        return pattern.replace("'", "''")

    return f"""
WITH RECURSIVE rules(rule_host, begins, verdict) AS (VALUES {rules}),
given AS (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html FROM pages),
known AS {split("given", "page_id, url, html", "url")},
tags AS (SELECT node AS origin, url, host, path, unnest(regexp_extract_all(html, '{q(TAGS)}')) AS tag FROM known WHERE host <> ''),
named AS (SELECT *, CASE WHEN regexp_matches(tag, '{q(CANONICAL)}')
            THEN regexp_extract(tag, '{q(HREF)}', 1) || regexp_extract(tag, '{q(HREF)}', 2) || regexp_extract(tag, '{q(HREF)}', 3)
            WHEN regexp_matches(tag, '{q(REFRESH)}') THEN regexp_extract(tag, '{q(REFRESH_URL)}', 1) ELSE '' END AS target FROM tags),
absolute AS (SELECT origin, CASE WHEN contains(target, '://') THEN target
            WHEN starts_with(target, '//') THEN regexp_extract(url, '^[^:/?#]*') || ':' || target
            WHEN starts_with(target, '/') THEN regexp_extract(url, '^[^:/?#]*') || '://' || host || target
            ELSE regexp_extract(url, '^[^:/?#]*') || '://' || host || regexp_extract(path, '^(.*)/[^/]*$', 1) || '/' || target
            END AS target FROM named WHERE target <> ''),
linked AS (SELECT * FROM {split("absolute", "origin", "target")} WHERE host <> ''),
edges AS (SELECT origin AS a, node AS b FROM linked UNION SELECT node, origin FROM linked),
reach(a, b) AS (SELECT a, b FROM edges UNION SELECT r.a, e.b FROM reach r JOIN edges e ON e.a = r.b),
places AS (SELECT host, path, node FROM known UNION SELECT host, path, node FROM linked),
fits AS (SELECT p.*, r.rule_host || r.begins AS rule, r.verdict,
                row_number() OVER (PARTITION BY p.node, p.host, p.path ORDER BY length(r.rule_host || r.begins) DESC) AS place
         FROM places p JOIN rules r
         ON (p.host = r.rule_host OR ends_with(p.host, '.' || r.rule_host)) AND starts_with(p.path, r.begins)),
judged AS (SELECT DISTINCT host, path, node, rule, verdict FROM fits WHERE place = 1),
aliases AS (SELECT r.a AS node, min(j.verdict) AS alias FROM reach r JOIN judged j ON j.node = r.b GROUP BY r.a)
SELECT k.page_id, k.host, k.path, j.rule, coalesce(j.verdict, x.alias, 'allow') AS verdict,
       CASE WHEN j.verdict IS NOT NULL THEN 'rule' WHEN x.alias IS NOT NULL THEN 'alias' ELSE 'none' END AS reason
FROM known k LEFT JOIN judged j ON j.node = k.node AND j.host = k.host AND j.path = k.path
LEFT JOIN aliases x ON x.node = k.node AND k.host <> ''
"""


@query("op9_url_filter", _sql())
def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page judged by the rules and its aliases."""
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return filter_urls(table(spark, sf_dir, "pages"), rules)
