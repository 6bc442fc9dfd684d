"""Commands and endpoints, answered end to end."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import console
from lodestone.plans.bindings import symbol_index, symbols, with_symbols
from lodestone.plans.facade_queries import _PAGES, _pages, _vectors, lexical_sql
from lodestone.plans.registry import query
from lodestone.plans.search_queries import LOGS, LOGS_SQL, NAMES_SQL
from lodestone.plans.vector_queries import RULES, rules


def catalogue(spark, d) -> console.Catalogue:
    rows = symbols(spark, d)
    moved = spark.createDataFrame([("oldRing", "newRing"), ("Gizmo", "newGizmo")], "old string, replacement string")
    every = rules(spark).withColumn("ecosystem", F.when(F.col("place") < 1, "android").otherwise("web"))
    return console.Catalogue(rows, _vectors(spark, d), _pages(rows), every, moved, symbol_index(spark, d))


@query("s19_status", with_symbols(" SELECT count(*) AS n, count(DISTINCT framework) AS frameworks, count(DISTINCT lower(kind)) AS kinds, count(*) FILTER (is_primary) AS primaries, (SELECT count(*) FROM embeddings) AS vectors FROM sym"))
def s19_status(spark, d):
    return console.dispatch(catalogue(spark, d), "  Version ")


@query("s19_search", lexical_sql(["red", "gear"], 40, 10))
def s19_search(spark, d):
    out = console.search(catalogue(spark, d), "  red gear ", " LEXICAL", framework="All", platform=" ", kind="all", limit="10")
    return out.select("id", "title", F.round("score", 6).alias("score"))


@query("s19_search_default", lexical_sql(["red", "gear"], 80, 20))
def s19_search_default(spark, d):
    """Unknown modes and malformed limits take the defaults; without a query vector a search by meaning stays lexical."""
    return console.search(catalogue(spark, d), "red gear", "odd", limit="many").select("id", "title", F.round("score", 6).alias("score"))


@query("s19_wildcard", with_symbols(""" SELECT id, title, round(score, 6) AS score FROM (SELECT id, title, CASE WHEN tm THEN 10.0::DOUBLE ELSE 1.0 END + CASE WHEN is_primary THEN 5.0::DOUBLE ELSE 0 END - least(5.0::DOUBLE, length(title) * 0.1::DOUBLE) AS score
  FROM (SELECT *, title ILIKE '_e%' AS tm FROM sym WHERE framework = 'Brand#1') WHERE tm OR abstract ILIKE '_e%' ORDER BY tm DESC, is_primary DESC, length(title), title, id LIMIT 20) ORDER BY score DESC, id LIMIT 5"""))
def s19_wildcard(spark, d):
    return console.search(catalogue(spark, d), "?e*", framework="Brand#1", limit=5).select("id", "title", F.round("score", 6).alias("score"))


@query("s19_doc", with_symbols(f", p AS ({_PAGES}), t AS (SELECT path AS target FROM sym WHERE id = 4), o AS (SELECT * FROM sym, t WHERE path = target ORDER BY is_primary DESC, id LIMIT 1) SELECT id, content, CASE WHEN content IS NULL THEN 'catalogue' ELSE 'page' END AS origin FROM o LEFT JOIN p ON o.path = p.path"))
def s19_doc(spark, d):
    of = catalogue(spark, d)
    return console.dispatch(of, "doc " + of.symbols.where("id = 4").first()["path"]).select("id", "content", "origin")


@query("s19_idioms", "SELECT * FROM (VALUES ('onesen'), ('that the')) t(rule)")
def s19_idioms(spark, d):
    return console.idioms(catalogue(spark, d), " Web ", "UI").select("rule")


@query("g06_frameworks", with_symbols(" SELECT framework, count(*) AS n FROM sym WHERE contains(lower(framework), 'd#2') GROUP BY framework"))
def g06_frameworks(spark, d):
    return console.dispatch(catalogue(spark, d), "discover D#2")


@query("g06_idiom_table", "SELECT * FROM (VALUES " + ", ".join("('{}', '{}')".format(r[1], ", ".join(r[4][:3])) for r in RULES) + ") t(rule, names)")
def g06_idiom_table(spark, d):
    return console.dispatch(catalogue(spark, d), "translate")


_DIAGNOSED = f"""{NAMES_SQL}, ex AS (SELECT lower(title) AS t, arg_min(title, (CASE WHEN is_primary THEN 0 ELSE 1 END) * 1000000000 + id) AS title FROM sym GROUP BY 1),
  near AS (SELECT name, first(title ORDER BY is_primary DESC, length(title), lower(title), id) AS title FROM (SELECT DISTINCT name FROM placed) JOIN sym ON starts_with(lower(title), lower(name)) GROUP BY name)
  SELECT place, p.name, CASE WHEN m.new IS NOT NULL THEN 'migration' WHEN ex.title IS NOT NULL THEN 'exact' WHEN near.title IS NOT NULL THEN 'suggestion' ELSE 'none' END AS match, coalesce(m.new, ex.title, near.title) AS target
  FROM placed p LEFT JOIN (VALUES ('oldRing', 'newRing'), ('Gizmo', 'newGizmo')) m(old, new) ON p.name = m.old LEFT JOIN ex ON lower(p.name) = ex.t LEFT JOIN near ON p.name = near.name WHERE place < 5"""


@query("g06_diagnose", with_symbols(", " + _DIAGNOSED.replace(LOGS_SQL, f"(SELECT 0 AS log_id, log FROM {LOGS_SQL} WHERE log_id = {LOGS[0][0]})")))
def g06_diagnose(spark, d):
    out = console.dispatch(catalogue(spark, d), "diagnose " + LOGS[0][1])
    return out.select(F.col("place").cast("long").alias("place"), "name", "match", "target")
