"""URL filters against a plain version and SQL."""

from __future__ import annotations

import random

import duckdb
import pytest

from hirelake.llm import url_filter as uf
from tests.check_queries import compare, connect

SCHEMA = "page_id long, url string, html string"
RULE_SCHEMA = "host string, path string, verdict string"


def rules(spark):
    return spark.createDataFrame(uf.RULES, RULE_SCHEMA)


def plain_rule(host, path):
    fits = [
        (len(h + p), h + p, v) for h, p, v in uf.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    return max(fits)[1:] if fits else (None, None)


@pytest.mark.parametrize(
    ("url", "host", "path", "rule"),
    [
        (None, "", "", None),
        ("", "", "", None),
        ("example.net/en/", "", "", None),
        ("http://EXAMPLE.net/en/x?y#z", "example.net", "/en/x", "example.net/en/"),
        ("http://a.Example.NET", "a.example.net", "", None),
        ("http://net?/", "net", "", None),
        ("x://a.net/EN/", "a.net", "/EN/", "net/"),
        ("http://internet/", "internet", "/", None),
        ("http://a.org/fr/#", "a.org", "/fr/", "org/fr/"),
        ("http://É.org://fr/fr/", "É.org:", "//fr/fr/", None),
        ("http://sub.example.com/de/?q=http://b.net/", "sub.example.com", "/de/", "example.com/de/"),
        ("http:///path", "", "/path", None),
        ("http://" + "a." * 2000 + "net/" + "x" * 100_000, "a." * 2000 + "net", "/" + "x" * 100_000, "net/"),
    ],
)
def test_parts_and_rules(spark, url, host, path, rule):
    row = uf.filter_urls(spark.createDataFrame([(1, url, None)], SCHEMA), rules(spark)).first()
    assert (row.host, row.path, row.rule) == (host, path, rule)
    assert row.verdict == (dict((h + p, v) for h, p, v in uf.RULES)[rule] if rule else "allow")


def canonical(url):
    return f'<html><link href="{url}" rel="canonical"></html>'


def aliased():
    return [
        (1, "http://a.com/x", canonical("https://b.net/y")),  # named a blocked url
        (2, "http://c.com/", "<META content='0; URL=http://a.com/x' HTTP-EQUIV=refresh>"),  # in two steps
        (3, "http://d.com/1", canonical("/2")),
        (4, "http://d.com/2#top", canonical("http://e.org/fr/z")),  # allowed
        (5, "http://e.com/", canonical("http://d.com/1")),
        (6, "http://e.com/b", canonical("//f.net/")),  # block and allow: allow goes first
        (7, "http://f.net/", canonical("http://example.net/en/q")),
        (8, "http://own.net/", canonical("http://example.net/en/q")),  # its own rule decides
        (9, "http://g.com/dir/page", canonical("other")),
        (10, "http://g.com/dir/other", "<link rel=canonical href=http://h.net/>"),
        (11, "http://alone.com/", '<link rel="stylesheet" href="http://b.net/y"><link rel="canonical"'),
        (12, None, canonical("http://b.net/y")),
        (12, None, canonical("http://b.net/y")),
        (None, "https://a.com/x", None),
    ]


def test_aliases(spark):
    pages = spark.createDataFrame([(*r, "z") for r in aliased()], SCHEMA + ", node string")
    got = sorted(((r.page_id or 0, r.verdict, r.reason) for r in uf.filter_urls(pages, rules(spark)).collect()))
    assert got == [
        (0, "block", "alias"), (1, "block", "alias"), (2, "block", "alias"), (3, "allow", "alias"), (4, "allow", "alias"),
        (5, "allow", "alias"), (6, "allow", "alias"), (7, "block", "rule"), (8, "block", "rule"), (9, "block", "alias"),
        (10, "block", "alias"), (11, "allow", "none"), (12, "allow", "none"), (12, "allow", "none"),
    ]


def test_sql_on_aliases(spark):
    pages = spark.createDataFrame(aliased(), SCHEMA)
    db = duckdb.connect()
    db.register("pages", pages.toPandas())
    assert compare(uf.filter_urls(pages, rules(spark)).toPandas(), db.execute(uf._sql()).df()) is None


def test_given_redirects_against_plain_components(spark):
    rng = random.Random(8)
    hosts = ["a.com", "b.com", "c.net", "example.net", "x.example.com", "d.org"]
    urls = [f"http://{rng.choice(hosts)}/{rng.choice(['en', 'de', 'fr'])}/{i}" for i in range(150)]
    edges = [(rng.choice(urls), rng.choice(urls)) for _ in range(90)] + [(urls[0], None), (None, urls[1]), ("x", urls[2])]
    near = {u: {u} for u in urls}
    for a, b in edges[:90]:
        merged = near[a] | near[b]
        for u in merged:
            near[u] = merged
    place = lambda u: (u[7:].partition("/")[0], "/" + u[7:].partition("/")[2])
    got = uf.filter_urls(
        spark.createDataFrame([(i, u, None) for i, u in enumerate(urls)], SCHEMA), rules(spark), spark.createDataFrame(edges, "s string, t string")
    )
    for r in got.collect():
        own = plain_rule(r.host, r.path)
        others = {plain_rule(*place(u))[1] for u in near[urls[r.page_id]]} - {None}
        assert r.rule == own[0]
        assert r.verdict == (own[1] or ("allow" if "allow" in others or not others else "block"))


def test_empty_table_and_query(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert uf.filter_urls(empty, rules(spark)).count() == 0
    folder = "/root/testdata/sf0.01"
    got = uf.op9_url_filter(spark, folder).toPandas()
    assert compare(got, connect(folder).execute(uf._sql()).df()) is None
    assert set(got.verdict) == {"allow", "block"}
