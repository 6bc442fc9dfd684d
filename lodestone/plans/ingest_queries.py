"""Ingestion, repair, sources and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lodestone.functions import kinds as K
from lodestone.operators import filters, health, ingest, resolve
from lodestone.plans.bindings import SYMBOLS, symbols, table, with_symbols
from lodestone.plans.registry import query


UPSERT = """WITH r AS (SELECT l_orderkey * 10 + l_linenumber AS id, CASE WHEN l_returnflag = 'N' THEN 'symbol' ELSE l_returnflag END AS kind, l_returnflag = 'R' AS is_primary,
    CASE WHEN l_linestatus = 'O' THEN '' ELSE l_linestatus || l_suppkey END AS abstract, l_partkey AS title, row_number() OVER (ORDER BY l_shipdate, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax) AS seq FROM lineitem)
  SELECT id, coalesce(arg_max(kind, seq) FILTER (kind <> 'symbol'), arg_max(kind, seq)) AS kind, coalesce(arg_max(is_primary, seq) FILTER (kind <> 'symbol'), arg_max(is_primary, seq)) AS is_primary,
    coalesce(arg_max(abstract, seq) FILTER (abstract <> ''), arg_max(abstract, seq)) AS abstract, arg_max(title, seq) AS title FROM r GROUP BY id"""


def line_items(spark, d):
    """lineitem as rows to upsert, `at` their order."""
    flag = F.col("l_returnflag")
    return table(spark, d, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"),
        F.when(flag == "N", "symbol").otherwise(flag).alias("kind"),
        (flag == "R").alias("is_primary"),
        F.when(F.col("l_linestatus") == "O", "").otherwise(F.concat("l_linestatus", F.col("l_suppkey").cast("string"))).alias("abstract"),
        F.col("l_partkey").alias("title"),
        F.struct("l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax").alias("at"),
    )


@query("i01_upsert", UPSERT)
def i01(spark, d):
    return ingest.upsert(line_items(spark, d), "id", ["at"]).select("id", "kind", "is_primary", "abstract", "title")


@query("i02_page_refs", r"""SELECT page_id, i AS place, regexp_extract(m, 'href="([^"]*)"', 1) AS href FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a href="[^"]*">')) AS m, generate_subscripts(regexp_extract_all(html, '<a href="[^"]*">'), 1) - 1 AS i FROM pages)""")
def i02(spark, d):
    links = F.regexp_extract_all("html", F.lit('<a href="([^"]*)">'), F.lit(1))
    return table(spark, d, "pages").select("page_id", F.posexplode(links).alias("place", "href")).withColumn("place", F.col("place").cast("long"))


PAGE = """{"metadata":{"title":"Gear","symbolKind":"class","platforms":[{"name":"iOS","introducedAt":"13.0"}]},"identifier":{"url":"doc://x/documentation/core/gear"},"abstract":[{"type":"text","text":"A  round"},{"type":"text","text":"thing"}],
"references":{"r1":{"title":"Ring","kind":"symbol","roleHeading":"Protocol","url":"/documentation/core/ring","abstract":[{"text":"Holds."}]},"r2":{"title":"Guide","kind":"article","url":"/documentation/core/guide"},"r3":{"kind":"symbol","url":"/x"},
"i1":{"type":"image","alt":"pic","variants":[{"traits":["1x","light"],"url":"a.png"},{"traits":["2x","light"],"url":"/b.jpg"}]},"v1":{"type":"video","variants":[{"url":"http://h/c.mp4"}]}}}"""


def _pages(spark):
    return spark.createDataFrame([(PAGE,)], "raw string").select(F.from_json("raw", ingest.PAGE_SCHEMA).alias("p")).select("p.*")


@query("i02_page_rows", """SELECT * FROM (VALUES ('Gear', 'class', 'A round thing', '/documentation/core/gear', 'iOS', true), ('Ring', 'protocol', 'Holds.', '/documentation/core/ring', 'iOS', true), ('Guide', 'article', '', '/documentation/core/guide', 'iOS', false)) t(title, kind, abstract, path, platforms, is_primary)""")
def i02_rows(spark, d):
    return ingest.page_rows(_pages(spark), F.lit("Core")).select("title", "kind", "abstract", "path", F.array_join("platforms", ",").alias("platforms"), "is_primary")


@query("i07_media", "SELECT * FROM (VALUES ('i1', 'pic', 'https://base/b.jpg', 'image/jpeg'), ('v1', '', 'http://h/c.mp4', 'video/mp4')) t(ref_id, alt, url, mime)")
def i07(spark, d):
    return ingest.media_rows(_pages(spark), "https://base")


_EDGES = """edges AS (
  SELECT 'r' || r_regionkey AS node, NULL::VARCHAR AS parent, r_regionkey AS ordinal, r_name AS title FROM region
  UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_nationkey, n_name FROM nation
  UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, s_suppkey, s_name FROM supplier)"""


@query("i03_tree", f"WITH RECURSIVE {_EDGES}, w AS (SELECT node, title, [CAST(ordinal AS BIGINT)] AS walk FROM edges WHERE parent IS NULL UNION ALL SELECT e.node, e.title, list_append(w.walk, CAST(e.ordinal AS BIGINT)) FROM edges e JOIN w ON e.parent = w.node) SELECT node, title, array_to_string(walk, '/') AS place FROM w")
def i03(spark, d):
    from lodestone.sources.catalog import ensure_checkpoint_dir

    ensure_checkpoint_dir(spark)
    row = lambda df, k, parent, title: df.select(k.alias("node"), parent.alias("parent"), title.alias("title"))
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    region, nation, supplier = table(spark, d, "region"), table(spark, d, "nation"), table(spark, d, "supplier")
    edges = row(region, key("r", "r_regionkey"), F.lit(None).cast("string"), F.col("r_name"))
    edges = edges.unionByName(row(nation, key("n", "n_nationkey"), key("r", "n_regionkey"), F.col("n_name")))
    edges = edges.unionByName(row(supplier, key("s", "s_suppkey"), key("n", "s_nationkey"), F.col("s_name")))
    edges = edges.withColumn("ordinal", F.substring("node", 2, 20).cast("long")).withColumn("path", F.concat(F.lit("/"), "node")).withColumn("type", F.lit("class"))
    return ingest.walk_tree(spark, edges).select("node", "title", F.array_join("place", "/").alias("place"))


@query("i04_kind_map", "SELECT p_partkey AS id, CASE p_type WHEN 'ECONOMY' THEN 'method' WHEN 'PROMO' THEN 'struct' WHEN 'LARGE' THEN 'article' WHEN 'SMALL' THEN 'unknown' WHEN 'MEDIUM' THEN 'odd kind' ELSE 'unknown' END AS kind FROM part")
def i04(spark, d):
    t = F.col("p_type")
    kind = F.when(t == "LARGE", "Article").when(t == "SMALL", "symbol").when(t == "MEDIUM", " Odd Kind ")
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), K.resolve(F.when(t == "ECONOMY", "Instance Method"), F.when(t == "PROMO", " Structure "), kind).alias("kind"))


@query("i05_primary_flag", with_symbols(" SELECT id, lower(kind) IN ('struct', 'class', 'protocol', 'enum', 'macro', 'union') AS flag FROM sym"))
def i05(spark, d):
    return symbols(spark, d).select("id", K.is_primary(F.col("kind")).alias("flag"))


@query("i08_replace", "SELECT p_partkey AS id, CASE WHEN p_partkey % 7 = 0 THEN 'new' ELSE 'old' END AS origin FROM part")
def i08(spark, d):
    part = table(spark, d, "part").select(F.col("p_partkey").alias("id"))
    return ingest.replace_by_id(part.withColumn("origin", F.lit("old")), part.where("id % 7 = 0").withColumn("origin", F.lit("new")), "id")


_NAMES = "names AS (SELECT 'brand' || x AS slug, 'Brand#' || CASE WHEN x = 3 THEN 30 ELSE x END AS canonical FROM range(1, 21) t(x))"


def _names(spark):
    x = F.col("id")
    return spark.range(1, 21).select(F.concat(F.lit("brand"), x.cast("string")).alias("slug"), F.concat(F.lit("Brand#"), F.when(x == 3, 30).otherwise(x).cast("string")).alias("canonical"))


@query("i09_point_updates", "SELECT p_partkey AS id, CASE WHEN p_partkey % 11 = 0 THEN 'fixed' ELSE p_type END AS kind FROM part")
def i09(spark, d):
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("kind"))
    return ingest.corrected(rows, rows.where("id % 11 = 0").select("id", F.lit("fixed").alias("kind")), "id", "kind")


@query("i11_repair", with_symbols(f", {_NAMES} SELECT id, framework, canonical FROM sym JOIN names ON slug = split_part(path, '/', 3) WHERE lower(framework) <> lower(canonical)"))
def i11(spark, d):
    return ingest.repairs(symbols(spark, d), _names(spark), "id")


@query("i11_kinds", with_symbols(" SELECT id, kind, 'struct' AS found FROM sym WHERE kind = 'symbol' AND path IN (SELECT path FROM sym WHERE id % 2 = 0)"))
def i11_kinds(spark, d):
    pages = symbols(spark, d).where("id % 2 = 0").select("path", F.lit(None).cast("string").alias("symbolKind"), F.lit("Structure").alias("roleHeading"))
    return ingest.kind_repairs(symbols(spark, d), pages, "id")


@query("i10_clear", "SELECT (SELECT count(*) FROM embeddings) * 0 AS vectors, 1 AS kept")
def i10(spark, d):
    meta = spark.createDataFrame([("built_at", "x"), ("embedding_model", "m"), ("has_embeddings", "true")], "key string, value string")
    vectors, left = ingest.cleared(table(spark, d, "embeddings"), meta)
    return vectors.agg(F.count("*").alias("vectors")).crossJoin(left.agg(F.count("*").cast("int").alias("kept")))  # one row each


@query("j08_topics", "SELECT page_id AS page, 'Links' AS topic, i AS place, h AS ref_id, 'T ' || h AS title FROM (SELECT page_id, unnest(l) AS h, generate_subscripts(l, 1) - 1 AS i FROM (SELECT page_id, regexp_extract_all(html, '<a href=\"([^\"]*)\">', 1) AS l FROM pages)) WHERE length(h) % 2 = 0")
def j08(spark, d):
    pages = table(spark, d, "pages").select(F.col("page_id").alias("page"), F.regexp_extract_all("html", F.lit('<a href="([^"]*)">'), F.lit(1)).alias("l"))
    known = F.array_distinct(F.filter("l", lambda h: F.length(h) % 2 == 0))
    pages = pages.select("page", F.array(F.struct(F.lit("Links").alias("title"), F.col("l").alias("identifiers"))).alias("topicSections"), F.map_from_arrays(known, F.transform(known, lambda h: F.struct(F.concat(F.lit("T "), h).alias("title")))).alias("references"))
    return ingest.topic_references(pages).withColumn("place", F.col("place").cast("long"))


@query("r08_canonical", with_symbols(f", {_NAMES} SELECT id, canonical FROM sym LEFT JOIN names ON slug = split_part(path, '/', 3)"))
def r08(spark, d):
    slugs = symbols(spark, d).select("id", resolve.framework_slug(F.col("path")).alias("slug"))
    return resolve.canonical_framework(slugs, _names(spark)).select("id", "canonical")


@query("i12_enrich", with_symbols(" SELECT s.id, CASE WHEN s.abstract = '' THEN coalesce('page of ' || p.path, '') ELSE s.abstract END AS abstract FROM sym s LEFT JOIN (SELECT DISTINCT path FROM sym WHERE id % 2 = 0) p ON s.path = p.path"))
def i12(spark, d):
    rows = symbols(spark, d)
    pages = rows.where("id % 2 = 0").select("path", F.concat(F.lit("page of "), "path").alias("text")).distinct()
    return ingest.enriched(rows, pages).select("id", "abstract")


@query("i13_meta", "SELECT event_type AS key, arg_max(value, event_id) AS value FROM events GROUP BY event_type")
def i13(spark, d):
    return ingest.meta_upsert(table(spark, d, "events"), "event_type", "value", "event_id")


@query("c03_props", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def c03(spark, d):
    return table(spark, d, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("p18_platforms", "SELECT * FROM (VALUES (0, 'iOS,macOS'), (1, ''), (2, ''), (3, ''), (4, '')) t(i, platforms)")
def p18(spark, d):
    rows = spark.createDataFrame([(0, '["iOS","macOS"]'), (1, "[]"), (2, "not json"), (3, None), (4, "{}")], "i int, raw string")
    from lodestone.sources.catalog import parse_platforms

    return rows.select("i", F.array_join(parse_platforms(F.col("raw")), ",").alias("platforms"))


@query("s10_archives", "SELECT regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS archive, count(*) AS pages, count(*) FILTER (length(html) < 400) AS corrupt FROM pages GROUP BY 1")
def s10(spark, d):
    from lodestone.sources.catalog import archive_counts

    pages = table(spark, d, "pages").select(F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("archive"), F.when(F.length("html") < 400, "short").alias("corrupt"))
    return archive_counts(pages)


@query("s12_vector_import", "SELECT vec_id AS id, CASE WHEN vec_id % 3 = 0 THEN 'import' ELSE 'own' END AS origin FROM embeddings")
def s12(spark, d):
    from lodestone.sources.catalog import ensure_checkpoint_dir, export_vectors, import_vectors

    own = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", F.lit("own").alias("origin"))
    path = f"{ensure_checkpoint_dir(spark)}/export-{uuid.uuid4().hex}"
    export_vectors(own.where("id % 3 = 0").withColumn("origin", F.lit("import")), 64, path, "m", "2024-01-01T00:00:00Z")
    return import_vectors(spark, path, own, "id").select("id", "origin")


@query("s13_checksum", "SELECT page_id, sha256(html) AS digest, octet_length(encode(html)) AS n_bytes FROM pages")
def s13(spark, d):
    return table(spark, d, "pages").select("page_id", F.sha2("html", 256).alias("digest"), F.octet_length("html").cast("long").alias("n_bytes"))


@query("s15_vector_export", "SELECT vec_id FROM embeddings WHERE len(embedding) = 64 AND label = 2")
def s15(spark, d):
    from lodestone.sources.catalog import export_rows

    return export_rows(table(spark, d, "embeddings"), 64, F.col("label") == 2).select("vec_id")


@query("s17_frameworks", f"WITH {SYMBOLS}, core AS (SELECT 'Brand#' || x AS name FROM range(1, 31) t(x)), c AS (SELECT lower(framework) AS f, count(*) AS n, count(*) FILTER (is_primary) AS p FROM sym GROUP BY 1) SELECT name, coalesce(n, 0) AS n, coalesce(p, 0) AS p FROM core LEFT JOIN c ON lower(name) = f")
def s17(spark, d):
    core = spark.range(1, 31).select(F.concat(F.lit("Brand#"), F.col("id").cast("string")).alias("name"))
    counts = symbols(spark, d).groupBy(F.col("framework").alias("name")).agg(F.count("*").alias("n"), F.count_if("is_primary").alias("p"))
    return health.zero_filled(core, counts, "name", ["n", "p"])


@query("s18_primary", with_symbols(" SELECT id, title FROM sym WHERE framework = 'Brand#4' AND is_primary ORDER BY title, id LIMIT 200"))
def s18(spark, d):
    return symbols(spark, d).where("framework = 'Brand#4' AND is_primary").orderBy("title", "id").limit(200).select("id", "title")
