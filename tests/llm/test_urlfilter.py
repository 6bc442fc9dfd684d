"""Rules, links and components against plain Python, and planted links against SQL."""

import random
from urllib.parse import urldefrag, urljoin

import pytest
from pyspark.sql import functions as F

from lodestone.llm import registry, urlfilter

from ..compare import assert_same
from .test_operators import connect, path, plain, run  # noqa: F401

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split(url):
    rest = (url or "").partition("://")[2]
    host = rest
    for c in "/?#":
        host = host.split(c)[0]
    return host.translate(LOWER), rest[len(host) :].split("?")[0].split("#")[0]


def own_rule(url):
    host, where = split(url)
    fits = [(h + p, a) for h, p, a in urlfilter.RULES if (host == h or host.endswith("." + h)) and where.startswith(p)]
    return max(fits, key=lambda r: len(r[0]), default=(None, None))


def node_of(url):
    bare = url.split("#")[0]
    head, mark, rest = bare.partition("://")
    return head.translate(LOWER) + mark + split(bare)[0] + rest[len(split(bare)[0]) :] if mark else bare


def verdicts(pages, edges):
    """pages (page_id, url), edges between URLs."""
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[find(node_of(a))] = find(node_of(b))
    said = {}
    for x in list(parent):
        if own_rule(x)[1]:
            said.setdefault(find(x), set()).add(own_rule(x)[1])
    out = []
    for page, url in pages:
        rule, action = own_rule(url)
        if not action and url is not None and node_of(url) in parent:
            action = min(said.get(find(node_of(url)), {"allow"}))
        out.append((page, *split(url), rule, action or "allow"))
    return out


LINKS = [
    (1, "http://a.net/it/1", '<link rel="canonical" href="http://b.net/fr/x">'),  # blocked by its alias
    (2, "http://c.net/it/2", "<LINK href='/es/y' REL='alternate Canonical'>"),  # relative, to a blocked path
    (3, "HTTP://D.org/3#top", '<meta http-equiv="Refresh" content="0; URL=http://c.net/it/2">'),  # chain to 2
    (4, "http://e.org/4", '<meta http-equiv=refresh content="5;url=\'http://b.net/fr/x\'"><link rel=canonical href=http://shop.com/>'),  # both: allow precedes, for 1 too
    (5, "http://www.example.com/en/1", '<link rel="canonical" href="http://m.example.com/en/1">'),  # own rules hold
    (6, "http://m.example.com/en/1", ""),
    (7, "http://f.org/a/b/c?x=1", '<link rel="canonical" href="../d?y=1&amp;z=2#q">'),
    (8, "http://f.org/a/d?y=1&z=2", '<link rel="canonical" href="//g.net/fr/">'),
    (9, "http://h.org", '<!-- <link rel="canonical" href="http://b.net/fr/x"> --><script>"<link rel=canonical href=http://b.net/fr/x>"</script>'),
    (10, "http://i.org/", '<link rel="canonical" href="mailto:x@b.net"><link rel="canonical" href="#here"><link rel=canonical href="">'),
    (11, "no scheme", '<link rel="canonical" href="/fr/">'),
    (12, None, '<link rel="canonical" href="http://b.net/fr/x">'),
    (13, "http://j.org/k", None),
    (14, "http://j.org/k", '<link rel="canonical" href="?p=2"><link rel="canonical" href="./l/.">'),
    (None, "http://k.net/es/", '<link rel="canonical" href="http://j.org/l/">'),
    (16, "z:" * 100_000, "<link rel='canonical' href='http://b.net/fr/x'>"),
    (15, "http://q.org/" + "long/" * 2000, '<link rel="canonical" href="../../x/' + "y" * 3000 + '">'),
    (15, "http://q.org/" + "long/" * 2000, '<link rel="canonical" href="../../x/' + "y" * 3000 + '">'),
]
EDGES = [(LINKS[i][1], urljoin(LINKS[i][1], to)) for i, to in ((0, "http://b.net/fr/x"), (1, "/es/y"), (2, "http://c.net/it/2"), (3, "http://b.net/fr/x"), (3, "http://shop.com/"), (4, "http://m.example.com/en/1"), (6, "../d?y=1&z=2"), (7, "//g.net/fr/"), (13, "?p=2"), (13, "./l/."), (14, "http://j.org/l/"), (16, "../../x/" + "y" * 3000))] + [(LINKS[15][1], "http://b.net/fr/x")]


@pytest.fixture(scope="module")
def links_dir(spark, tmp_path_factory):
    where = str(tmp_path_factory.mktemp("links"))
    spark.createDataFrame(LINKS, "page_id long, url string, html string").withColumn("host", F.lit(1)).withColumn("node", F.lit(2)).write.parquet(f"{where}/pages.parquet")
    for t in ("documents", "labels", "benchmark", "conversations"):
        spark.createDataFrame([(1,)], "x int").write.parquet(f"{where}/{t}.parquet")
    return where


def test_links_are_read_and_resolved(spark, links_dir):
    got = urlfilter.link_edges(spark.read.parquet(f"{links_dir}/pages.parquet")).collect()
    assert sorted(map(tuple, got)) == sorted({(node_of(a), urldefrag(b)[0]) for a, b in EDGES})


def test_aliases_take_decisions(spark, links_dir):
    want = plain(verdicts([(p, u) for p, u, _ in LINKS], EDGES))
    assert run(spark, "op12_url_filters", links_dir, "page_id", "host", "path", "rule", "verdict") == want
    assert {r[0]: r[4] for r in want if r[0] in (1, 2, 3, 4, 6, 8, 9, 14)} == {1: "allow", 2: "block", 3: "block", 4: "allow", 6: "block", 8: "block", 9: "allow", 14: "block"}
    assert_same(registry.QUERIES["op12_url_filters"](spark, links_dir), connect(links_dir), registry.ORACLE_SQL["op12_url_filters"])


def test_rows(spark, path):  # noqa: F811
    pages = [(r["page_id"], r["url"]) for r in spark.read.parquet(f"{path}/pages.parquet").collect()]
    assert run(spark, "op12_url_filters", path, "page_id", "host", "path", "rule", "verdict") == plain(verdicts(pages, []))


def test_rules_that_tie_and_nest(spark):
    rules = urlfilter.rule_table(spark, [("a.com", "/", "block"), ("com", "/xy", "allow"), ("b.a.com", "", "allow"), ("a.com", "/p/", "block"), ("a.com", "/p/", "allow")])
    places = spark.createDataFrame([("a.com", "/xyz"), ("b.a.com", "/"), ("xa.com", "/q"), ("xa.com", "/xy"), ("a.com", "/p/1"), ("", ""), ("com", "/xy")], "host string, path string")
    got = {(r["host"], r["path"]): (r["rule"], r["action"]) for r in urlfilter.fitting_rules(places, rules).collect()}
    assert got == {("a.com", "/xyz"): ("a.com/", "block"), ("b.a.com", "/"): ("b.a.com", "allow"), ("xa.com", "/xy"): ("com/xy", "allow"), ("a.com", "/p/1"): ("a.com/p/", "allow"), ("com", "/xy"): ("com/xy", "allow")}


def test_components_of_chains_stars_and_random_graphs(spark):
    rng = random.Random(5)
    names = [f"n{i:05d}" for i in range(3000)]
    rng.shuffle(names)
    edges = [(names[i], names[i + 1]) for i in range(0, 900)]  # a chain
    edges += [(names[1000], names[i]) for i in range(1001, 1800)]  # a hub
    edges += [(names[rng.randrange(2000, 3000)], names[rng.randrange(2000, 3000)]) for _ in range(450)]
    got = {r["node"]: r["root"] for r in urlfilter.components(spark.createDataFrame(edges, "a string, b string")).collect()}
    parent = {x: x for e in edges for x in e if e[0] != e[1]}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            lo, hi = sorted((find(a), find(b)))
            parent[hi] = lo
    assert got == {x: find(x) for x in parent}


def test_given_edges(spark):
    pages = spark.createDataFrame([(1, "http://x.org/1", None), (2, "http://x.org/2", None)], "page_id long, url string, html string")
    edges = spark.createDataFrame([("http://X.org/1#a", "http://y.net/es/"), (None, "http://x.org/2"), ("http://x.org/2", "http://x.org/2")], "a string, b string")
    got = {r["page_id"]: (r["alias_action"], r["verdict"]) for r in urlfilter.judge(pages, urlfilter.rule_table(spark), edges).collect()}
    assert got == {1: ("block", "block"), 2: (None, "allow")}


def test_no_python_on_the_main_path(spark, sf_dir):
    plan = registry.QUERIES["op12_url_filters"](spark, sf_dir)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
