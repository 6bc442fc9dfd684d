"""Allow and block rules over URLs, carried to aliases by redirects and canonical links, in DataFrame operations only.

1. Rules (host, path, action) fit their host and all subdomains where the path begins as theirs; the longest wins (host and path together,
   then the longer host, then allow).  Addresses meet rules by an equi-join on the suffixes of their hosts.
2. Edges join addresses that stand for one resource: canonical links and refresh redirects of the pages, and any further ones given,
   such as a redirect log.  An address is a URL without fragment, its scheme and host in lower case.
3. Connected components by alternating large and small stars: every round replaces an address's neighbours by the smallest of them, so that
   chains halve and all edges end at the smallest address.  A round is two minima and two joins; hubs are merged before each shuffle.
4. A component that holds an address with an explicit allow allows its other members, else one with a block blocks them.  A page's own rule
   comes first, then its component's decision, then allow.

Defined cases: a null URL, or one without ``://``, has empty host and path, fits no rule and is allowed unless its equal text is linked; null
and repeated page ids and repeated rows are judged row by row; null or empty html has no links; links that lead nowhere on the web (fragments,
mailto and the like) are left out; a link into a page that was not read still joins its aliases, and rules on its address count; tags end at
their first ``>``; comments, scripts and styles are no tags; an empty table gives no rows; only page_id, url and html are read.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import discard, stored, table

RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_NO_TAGS = r"(?is)<!--.*?-->|<script\b.*?</script|<style\b.*?</style"
_TAG = r"(?i)<(?:link|meta)\b[^>]*>"


def _lower(c: Column) -> Column:
    return F.translate(c, _UPPER, _LOWER)


def _bound(value: Column, fn: Callable[[Column], Column]) -> Column:
    """fn of the value, with the value computed once: written out, nested uses would double the plan at each step."""
    return F.element_at(F.transform(F.array(value), fn), 1)


def _rest(url: Column) -> Column:
    """What follows the first ://, or nothing."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    return _lower(F.regexp_extract(_rest(F.coalesce(url, F.lit(""))), r"^[^/?#]*", 0))


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(F.coalesce(url, F.lit(""))), r"^[^/?#]*([^?#]*)", 1)


def address(url: Column) -> Column:
    """The URL without fragment, scheme and host in lower case."""
    return F.concat(_lower(F.regexp_extract(url, r"^[^#]*?://[^/?#]*|", 0)), F.regexp_extract(url, r"^(?:[^#]*?://[^/?#]*)?([^#]*)", 1))


def _attribute(tag: Column, name: str) -> Column:
    pattern = rf"""(?i)[\s"']{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))"""
    return F.concat(*(F.regexp_extract(tag, pattern, k) for k in (1, 2, 3)))


def link_target(tag: Column) -> Column:
    """Where a canonical link or a refresh points, as written; empty for other tags."""
    is_link = F.lower(tag).startswith("<link")
    canonical = F.array_contains(F.split(F.lower(_attribute(tag, "rel")), r"\s+"), "canonical")
    refresh = F.lower(F.trim(_attribute(tag, "http-equiv"))) == "refresh"
    to = F.regexp_extract(_attribute(tag, "content"), r"(?i)^[\s\d.]*[;,]?\s*url\s*=\s*(.*)$", 1)
    href = F.when(is_link & canonical, _attribute(tag, "href")).when(~is_link & refresh, F.regexp_replace(F.trim(to), r"""^['"]|['"]$""", "")).otherwise("")
    return F.replace(F.trim(href), F.lit("&amp;"), F.lit("&"))


def resolve(href: Column, base: Column) -> Column:
    """The URL a link on the page at `base` leads to; null if it leads nowhere on the web."""
    scheme, place = F.regexp_extract(base, r"^([^:/?#]*)://", 1), F.regexp_extract(base, r"^[^:/?#]*://[^/?#]*", 0)
    head, tail = F.regexp_extract(href, r"^[^?#]*", 0), F.regexp_extract(href, r"[?#].*$", 0)
    whole = F.when(head.startswith("/"), head).when(head == "", path_of(base)).otherwise(F.concat(F.regexp_replace(path_of(base), r"[^/]*$", ""), head))

    def without_dots(path: Column) -> Column:
        kept = F.aggregate(
            F.split(path, "/", -1),
            F.array().cast("array<string>"),
            lambda acc, s: F.when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(1)))).when(s == ".", acc).otherwise(F.concat(acc, F.array(s))),
        )
        flat = F.concat(F.array_join(kept, "/"), F.when(path.rlike(r"/\.\.?$"), "/").otherwise(""))
        return F.when(path.rlike(r"/\.\.?(/|$)"), flat).otherwise(path)

    rooted = _bound(F.concat(F.when(whole.startswith("/"), "").otherwise("/"), whole), without_dots)
    return (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), F.when(href.rlike(r"(?i)^https?://"), href))
        .when((href == "") | href.startswith("#") | (scheme == ""), F.lit(None))
        .when(href.startswith("//"), F.concat(scheme, F.lit(":"), href))
        .otherwise(F.concat(place, rooted, tail))
    )


def link_edges(pages: DataFrame) -> DataFrame:
    """(a, b): distinct pairs of addresses that the canonical links and refreshes of pages (url, html) join."""
    hinted = pages.where(F.col("url").isNotNull() & F.col("html").rlike(r"(?i)canonical|http-equiv"))
    tags = hinted.select("url", F.explode(F.regexp_extract_all(F.regexp_replace("html", _NO_TAGS, " "), F.lit(_TAG), 0)).alias("tag"))
    targets = tags.select("url", F.explode(F.array(link_target(F.col("tag")))).alias("href")).where("href <> ''")  # explode keeps the steps apart
    found = targets.select("url", F.explode(F.array(resolve(F.col("href"), F.col("url")))).alias("to")).where("to IS NOT NULL")
    return found.select(address(F.col("url")).alias("a"), address(F.col("to")).alias("b")).where("a <> b").distinct()


def _mark(edges: DataFrame) -> tuple:
    """Two edge sets that differ have unlike marks, but for a chance of 2**-64."""
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of edges (a, b): root is the smallest node of its component."""
    at = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    mark, done = None, _mark(at)
    while done[0] and mark != done:
        both = at.unionByName(at.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        pairs = F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a").alias("a"), F.col("m").alias("b")))).alias("e")
        after = stored(joined.select(pairs).select("e.*").where("a <> b").distinct(), "edges")
        discard(at)
        at, mark, done = after, done, _mark(after)
    return at.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(at.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()


def fitting_rules(places: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, path, rule, action): the longest rule that fits, for each distinct (host, path) that has one."""
    labels = F.split("host", r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    named = rules.select(F.col("host").alias("suffix"), F.col("path").alias("begins"), F.col("action").alias("says"), F.concat("host", "path").alias("rule"))
    met = places.where("host <> ''").select("host", "path").distinct().withColumn("suffix", F.explode(suffixes)).join(named, "suffix")
    met = met.where(F.startswith("path", "begins"))
    rank = F.struct(F.length("rule"), F.length("suffix"), (F.col("says") == "allow").alias("allow"), "rule", "says")
    best = met.groupBy("host", "path").agg(F.max(rank).alias("best"))
    return best.select("host", "path", F.col("best.rule").alias("rule"), F.col("best.says").alias("action"))


def judge(pages: DataFrame, rules: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """(page_id, url, host, path, rule, alias_action, verdict) for each row of pages (page_id, url, html); edges (a, b) of URLs add to those of the pages."""
    linked = link_edges(pages)
    if edges is not None:
        linked = linked.unionByName(edges.select(address(F.col("a")).alias("a"), address(F.col("b")).alias("b")).where("a IS NOT NULL AND b IS NOT NULL"))
    of = stored(components(linked), "components")
    known = of.select("node", "root", host_of(F.col("node")).alias("host"), path_of(F.col("node")).alias("path"))
    known = known.join(fitting_rules(known, rules), ["host", "path"])
    said = known.groupBy("root").agg(F.max(F.col("action") == "allow").alias("allowed"))
    aliases = of.join(said, "root").select("node", F.when(F.col("allowed"), "allow").otherwise("block").alias("alias_action"))

    own = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), address(F.col("url")).alias("node"))
    own = own.join(fitting_rules(own, rules), ["host", "path"], "left").join(aliases, "node", "left")
    return own.select("page_id", "url", "host", "path", "rule", "alias_action", F.coalesce("action", "alias_action", F.lit("allow")).alias("verdict"))


def rule_table(spark: SparkSession, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    return spark.createDataFrame([*rules], "host string, path string, action string")


def op12_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.sql("SELECT * FROM VALUES " + ", ".join(str(r) for r in RULES) + " AS t(host, path, action)")  # literals stay on the JVM
    return judge(table(spark, sf_dir, "pages").select("page_id", "url", "html"), rules).select("page_id", "host", "path", "rule", "verdict")


def _sql_host(url: str) -> str:
    return rf"translate(regexp_extract(CASE WHEN instr({url}, '://') > 0 THEN substr({url}, instr({url}, '://') + 3) ELSE '' END, '^[^/?#]*', 0), '{_UPPER}', '{_LOWER}')"


def _sql_path(url: str) -> str:
    return rf"regexp_extract(CASE WHEN instr({url}, '://') > 0 THEN substr({url}, instr({url}, '://') + 3) ELSE '' END, '^[^/?#]*([^?#]*)', 1)"


def _sql_address(url: str) -> str:
    bare = f"regexp_extract({url}, '^[^#]*', 0)"
    return rf"""CASE WHEN instr({bare}, '://') > 0 THEN translate(substr({bare}, 1, instr({bare}, '://') + 2), '{_UPPER}', '{_LOWER}') || {_sql_host(bare)} ||
      regexp_extract(substr({bare}, instr({bare}, '://') + 3), '(?s)^[^/?#]*(.*)', 1) ELSE {bare} END"""


def _sql_attribute(name: str) -> str:
    pattern = rf"""(?i)[\s"'']{name}\s*=\s*(?:"([^"]*)"|''([^'']*)''|([^\s>"'']+))"""
    return " || ".join(f"regexp_extract(tag, '{pattern}', {k})" for k in (1, 2, 3))


OP12_SQL = rf"""
WITH RECURSIVE rules(rhost, rpath, action) AS (
  VALUES {", ".join(str(r) for r in RULES)}
), page AS (
  SELECT row_number() OVER () AS r, page_id, url, html, coalesce({_sql_host("url")}, '') AS host, coalesce({_sql_path("url")}, '') AS path, {_sql_address("url")} AS node FROM pages
), tags AS (
  SELECT url, node, unnest(regexp_extract_all(regexp_replace(html, '(?is)<!--.*?-->|<script\b.*?</script|<style\b.*?</style', ' ', 'g'), '(?i)<(?:link|meta)\b[^>]*>')) AS tag
  FROM page WHERE url IS NOT NULL AND regexp_matches(html, '(?i)canonical|http-equiv')
), hrefs AS (
  SELECT url, node, replace(trim(CASE WHEN lower(tag) LIKE '<link%' THEN CASE WHEN list_contains(regexp_split_to_array(lower({_sql_attribute("rel")}), '\s+'), 'canonical') THEN {_sql_attribute("href")} ELSE '' END
    WHEN lower(trim({_sql_attribute("http-equiv")})) = 'refresh' THEN regexp_replace(trim(regexp_extract({_sql_attribute("content")}, '(?i)^[\s\d.]*[;,]?\s*url\s*=\s*(.*)$', 1)), '^[''"]|[''"]$', '', 'g') ELSE '' END), '&amp;', '&') AS href FROM tags
), based AS (
  SELECT *, regexp_extract(url, '^([^:/?#]*)://', 1) AS scheme, regexp_extract(url, '^[^:/?#]*://[^/?#]*', 0) AS place, {_sql_path("url")} AS base, regexp_extract(href, '^[^?#]*', 0) AS head, regexp_extract(href, '[?#].*$', 0) AS tail
  FROM hrefs WHERE href <> ''
), joined AS (
  SELECT *, CASE WHEN head LIKE '/%' THEN head WHEN head = '' THEN base ELSE regexp_replace(base, '[^/]*$', '') || head END AS p FROM based
), rooted AS (
  SELECT * REPLACE (CASE WHEN p LIKE '/%' THEN p ELSE '/' || p END AS p) FROM joined
), flat AS (
  SELECT *, CASE WHEN regexp_matches(p, '/\.\.?(/|$)') THEN array_to_string(list_reduce(list_transform(string_split(p, '/'), lambda s: [s]),
      lambda acc, s: CASE WHEN s[1] = '..' THEN acc[1:greatest(len(acc) - 1, 1)] WHEN s[1] = '.' THEN acc ELSE list_concat(acc, s) END), '/') || CASE WHEN regexp_matches(p, '/\.\.?$') THEN '/' ELSE '' END ELSE p END AS q FROM rooted
), targets AS (
  SELECT node, CASE WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.\-]*:') THEN CASE WHEN regexp_matches(href, '(?i)^https?://') THEN href END
    WHEN href LIKE '#%' OR scheme = '' THEN NULL WHEN href LIKE '//%' THEN scheme || ':' || href ELSE place || q || tail END AS href FROM flat
), edge AS (
  SELECT DISTINCT node AS a, {_sql_address("href")} AS b FROM targets WHERE href IS NOT NULL
), both_ways AS (
  SELECT a, b FROM edge UNION SELECT b, a FROM edge
), reach AS (
  SELECT a, a AS b FROM both_ways UNION SELECT reach.a, both_ways.b FROM reach JOIN both_ways ON reach.b = both_ways.a
), place AS (
  SELECT a AS node, {_sql_host("a")} AS host, {_sql_path("a")} AS path FROM reach UNION SELECT node, host, path FROM page WHERE node IS NOT NULL
), ruled AS (
  SELECT node, rhost || rpath AS rule, action FROM place JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
  QUALIFY row_number() OVER (PARTITION BY node ORDER BY length(rhost || rpath) DESC, length(rhost) DESC, action) = 1
), alias AS (
  SELECT reach.a AS node, min(action) AS action FROM reach JOIN ruled ON ruled.node = reach.b GROUP BY reach.a
)
SELECT page_id, host, path, ruled.rule, coalesce(ruled.action, alias.action, 'allow') AS verdict FROM page LEFT JOIN ruled USING (node) LEFT JOIN alias USING (node)
"""
