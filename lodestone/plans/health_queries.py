"""Counts, joins, freshness and the health report."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import kinds as K
from lodestone.functions import text as T
from lodestone.operators import fulltext, health, resolve
from lodestone.plans.bindings import document_index, symbol_index, symbols, table, with_symbols
from lodestone.plans.registry import query
from lodestone.sources import store


@query("a01_counts", with_symbols(" SELECT 'symbols' AS name, count(*) AS n FROM sym UNION ALL SELECT 'vectors', count(*) FROM embeddings"))
def a01(spark, d):
    n = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
    return n(symbols(spark, d), "symbols").unionByName(n(table(spark, d, "embeddings"), "vectors"))


@query("a02_frameworks", with_symbols(" SELECT DISTINCT framework FROM sym"))
def a02(spark, d):
    return symbols(spark, d).select("framework").distinct().orderBy("framework")


@query("a03_by_framework", with_symbols(" SELECT framework, count(*) AS n FROM sym GROUP BY 1"))
def a03(spark, d):
    return health.count_by(symbols(spark, d), "framework").orderBy(F.col("n").desc(), "framework")


@query("a04_primary_by_framework", with_symbols(" SELECT framework, count(*) AS n FROM sym WHERE is_primary GROUP BY 1"))
def a04(spark, d):
    return health.count_by(symbols(spark, d), "framework", F.col("is_primary"))


@query("a05_kind_dist", with_symbols(""", c AS (SELECT framework AS value, count(*) AS n FROM sym GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, value) AS place FROM c)
  SELECT CASE WHEN place <= 12 THEN value ELSE 'other' END AS value, CAST(least(place, 13) AS BIGINT) AS place, CAST(sum(n) AS BIGINT) AS n FROM r GROUP BY 1, 2"""))
def a05(spark, d):
    return health.distribution(symbols(spark, d), F.col("framework")).withColumn("place", F.col("place").cast("long"))


@query("a06_unknown_share", with_symbols(" SELECT count(*) AS total, count(*) FILTER (kind = 'symbol') AS unknown, round(100.0::DOUBLE * count(*) FILTER (kind = 'symbol') / count(*), 2) AS percent FROM sym"))
def a06(spark, d):
    return health.unknown_share(symbols(spark, d))


@query("a07_path_mismatch", with_symbols(" SELECT count(*) FILTER (split_part(path, '/', 3) <> lower(replace(framework, '#', ''))) AS mismatches, count(*) AS total FROM (SELECT * REPLACE (CASE WHEN id % 13 = 0 THEN '/documentation/Other/x' ELSE path END AS path) FROM sym)"))
def a07(spark, d):
    rows = symbols(spark, d).withColumn("path", F.when(F.col("id") % 13 == 0, "/documentation/Other/x").otherwise(F.col("path")))
    slug = resolve.framework_slug(F.col("path"))
    return rows.agg(F.count_if(slug != F.lower(F.regexp_replace("framework", "#", ""))).alias("mismatches"), F.count("*").alias("total"))


@query("a08_index_drift", "SELECT count(DISTINCT doc_id) AS indexed, count(*) AS base, count(DISTINCT doc_id) <> count(*) AS drift FROM documents")
def a08(spark, d):
    return fulltext.index_drift(table(spark, d, "documents").select("doc_id"), spark, document_index(spark, d))


@query("a09_embedding_status", "SELECT count(*) AS n, CASE WHEN count(*) >= 100 THEN 'hybrid' ELSE 'lexical' END AS mode FROM embeddings")
def a09(spark, d):
    return table(spark, d, "embeddings").agg(F.count("*").alias("n")).withColumn("mode", F.when(F.col("n") >= 100, "hybrid").otherwise("lexical"))


@query("a10_split", with_symbols(" SELECT framework, count(*) AS n, CASE WHEN count(*) >= 80 THEN 'indexed' ELSE 'cross-reference' END AS state FROM sym GROUP BY 1"))
def a10(spark, d):
    return health.indexed_split(health.count_by(symbols(spark, d), "framework"), 80)


@query("a11_freshness", "SELECT event_type, CAST(greatest(0, floor((epoch(TIMESTAMP '2024-02-20 00:00:00') - floor(epoch(max(ts)))) / 86400)) AS BIGINT) AS age, CASE WHEN floor((epoch(TIMESTAMP '2024-02-20 00:00:00') - floor(epoch(max(ts)))) / 86400) > 30 THEN 'stale' ELSE 'fresh' END AS state FROM events GROUP BY event_type")
def a11(spark, d):
    latest = table(spark, d, "events").groupBy("event_type").agg(F.max("ts").alias("ts"))
    age, state = health.freshness(F.col("ts"), F.lit("2024-02-20 00:00:00").cast("timestamp"))
    return latest.select("event_type", age.alias("age"), state.alias("state"))


_DOCTOR = with_symbols(""", n AS (SELECT count(*)::DOUBLE AS n, count(DISTINCT framework)::DOUBLE AS f, count(*) - count(DISTINCT id) AS dup, count(*) FILTER (kind = 'symbol') AS unk, count(*) FILTER (abstract = '') AS emp FROM sym),
  v AS (SELECT count(*)::DOUBLE AS n, count(DISTINCT len(embedding)) AS w, count(*) FILTER (len(embedding) <> 64) AS odd FROM embeddings)
  SELECT 'rows' AS check_name, CASE WHEN n > 0 THEN 'ok' ELSE 'fail' END AS status, n AS value FROM n
  UNION ALL SELECT 'frameworks', CASE WHEN f > 0 THEN 'ok' ELSE 'fail' END, f FROM n
  UNION ALL SELECT 'duplicate-ids', CASE WHEN dup = 0 THEN 'ok' ELSE 'fail' END, dup::DOUBLE FROM n
  UNION ALL SELECT 'unknown-kinds', CASE WHEN unk * 100 <= n * 5 THEN 'ok' WHEN unk * 100 <= n * 20 THEN 'warn' ELSE 'fail' END, 100.0::DOUBLE * unk / n FROM n
  UNION ALL SELECT 'empty-abstracts', CASE WHEN emp * 2 <= n THEN 'ok' ELSE 'warn' END, 100.0::DOUBLE * emp / n FROM n
  UNION ALL SELECT 'paths', 'ok', 0.0::DOUBLE
  UNION ALL SELECT 'vectors', CASE WHEN n >= 100 THEN 'ok' WHEN n > 0 THEN 'warn' ELSE 'fail' END, n FROM v
  UNION ALL SELECT 'vector-widths', CASE WHEN w <= 1 THEN 'ok' ELSE 'fail' END, w::DOUBLE FROM v
  UNION ALL SELECT 'expected-width', CASE WHEN odd = 0 THEN 'ok' ELSE 'warn' END, odd::DOUBLE FROM v
  UNION ALL SELECT 'index-drift', 'ok', 0.0::DOUBLE
  UNION ALL SELECT 'freshness', CASE WHEN age > 30 THEN 'warn' ELSE 'ok' END, age::DOUBLE FROM (SELECT CAST(greatest(0, floor((epoch(TIMESTAMP '2024-02-20 00:00:00') - floor(epoch(max(ts)))) / 86400)) AS BIGINT) AS age FROM events)""")


def _doctor(spark, d):
    report = health.doctor(symbols(spark, d), table(spark, d, "embeddings"), fulltext.index_drift(symbols(spark, d), spark, symbol_index(spark, d)))
    return report.unionByName(health.stamp_check(table(spark, d, "events"), F.lit("2024-02-20 00:00:00").cast("timestamp")))


@query("a12_doctor", _DOCTOR)
def a12(spark, d):
    return _doctor(spark, d).select("check_name", "status", "value")


@query("a12_summary", f"SELECT status, count(*) AS n FROM ({_DOCTOR}) GROUP BY status")
def a12_summary(spark, d):
    return health.summary(_doctor(spark, d))


@query("a13_index_info", with_symbols(" SELECT count(*) AS n, count(DISTINCT framework) AS frameworks, count(DISTINCT lower(kind)) AS kinds, count(*) FILTER (is_primary) AS primaries, (SELECT count(*) FROM embeddings) AS vectors FROM sym"))
def a13(spark, d):
    return health.index_info(symbols(spark, d), table(spark, d, "embeddings"))


@query("a16_schema", "SELECT 'nation' AS table_name, c AS column_name, t AS type, (SELECT count(*) FROM nation) AS rows FROM (VALUES ('n_nationkey', 'int'), ('n_name', 'string'), ('n_regionkey', 'int')) v(c, t) UNION ALL SELECT 'benchmark', c, t, (SELECT count(*) FROM benchmark) FROM (VALUES ('item_id', 'bigint'), ('text', 'string')) v(c, t)")
def a16(spark, d):
    return store.schema_snapshot({name: table(spark, d, name) for name in ("nation", "benchmark")})


@query("p14_discover_abstract", with_symbols(", core AS (SELECT 'Brand#' || x AS name, CASE WHEN x % 3 = 0 THEN 'Tools for Rings' ELSE 'other' END AS about FROM range(1, 31) t(x)), c AS (SELECT lower(framework) AS f, count(*) AS n FROM sym GROUP BY 1) SELECT name, n FROM core JOIN c ON lower(name) = f WHERE contains(lower(name), 'ring') OR contains(lower(about), 'ring')"))
def p14(spark, d):
    core = spark.range(1, 31).select(F.concat(F.lit("Brand#"), F.col("id").cast("string")).alias("name"), F.when(F.col("id") % 3 == 0, "Tools for Rings").otherwise("other").alias("about"))
    counts = symbols(spark, d).groupBy(F.col("framework").alias("name")).agg(F.count("*").alias("n"))
    return health.discover(core, counts, "name", "Ring", abstract="about").select("name", "n")


@query("a17_violation_samples", with_symbols(" SELECT id FROM sym WHERE abstract = '' ORDER BY id LIMIT 8"))
def a17(spark, d):
    return symbols(spark, d).where("abstract = ''").select("id").orderBy("id").limit(8)


@query("a18_discover", with_symbols(", core AS (SELECT 'Brand#' || x AS name FROM range(1, 31) t(x)), c AS (SELECT lower(framework) AS f, count(*) AS n FROM sym GROUP BY 1) SELECT name, n, n < 80 AS cross_reference FROM core JOIN c ON lower(name) = f WHERE contains(lower(name), '1')"))
def a18(spark, d):
    core = spark.range(1, 31).select(F.concat(F.lit("Brand#"), F.col("id").cast("string")).alias("name"))
    counts = symbols(spark, d).groupBy(F.col("framework").alias("name")).agg(F.count("*").alias("n"))
    return health.discover(core, counts, "name", "1", threshold=80)


@query("j06_left_zero_fill", "SELECT n_name, coalesce(c, 0) AS customers FROM nation LEFT JOIN (SELECT c_nationkey, count(*) AS c FROM customer WHERE c_mktsegment = 'MACHINERY' GROUP BY 1) ON n_nationkey = c_nationkey")
def j06(spark, d):
    counts = table(spark, d, "customer").where("c_mktsegment = 'MACHINERY'").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("c"))
    return table(spark, d, "nation").join(counts, "n_nationkey", "left").select("n_name", F.coalesce("c", F.lit(0)).alias("customers"))


@query("j03_anti", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def j03(spark, d):
    orders = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").select("c_custkey").join(orders, "c_custkey", "left_anti")


@query("j07_semi", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def j07(spark, d):
    orders = table(spark, d, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").select("c_custkey").join(orders, "c_custkey", "left_semi")


@query("c13_age_days", "SELECT o_orderkey, CAST(greatest(0, floor((epoch(TIMESTAMP '1998-01-01') - epoch(o_orderdate)) / 86400)) AS BIGINT) AS age FROM orders")
def c13(spark, d):
    return table(spark, d, "orders").select("o_orderkey", T.age_days(F.col("o_orderdate"), F.lit("1998-01-01").cast("timestamp")).alias("age"))


@query("c15_format", with_symbols(" SELECT framework, format('{:,}', count(*) * 1000) AS shown, round(100.0::DOUBLE * count(*) / (SELECT count(*) FROM sym), 2) AS percent FROM sym GROUP BY 1"))
def c15(spark, d):
    rows = symbols(spark, d)
    total = rows.agg(F.count("*").alias("total"))
    counts = health.count_by(rows, "framework").crossJoin(F.broadcast(total))  # one row
    return counts.select("framework", T.format_count(F.col("n") * 1000).alias("shown"), F.round(100.0 * F.col("n") / F.col("total"), 2).alias("percent"))


@query("p06_unknown_kind", with_symbols(" SELECT id, kind = 'symbol' AS unknown FROM sym"))
def p06(spark, d):
    return symbols(spark, d).select("id", K.is_unknown(F.col("kind")).alias("unknown"))
