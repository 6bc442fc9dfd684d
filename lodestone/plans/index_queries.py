"""Queries answered from stored indexes: segments, trigrams, deletion variants and cells.  Each is built once an application and source, by lodestone.operators.fulltext.built_once."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import cells, complete, filters, fulltext, fusion, fuzzy, grams, resolve
from lodestone.operators.segments import SegmentedIndex
from lodestone.plans.bindings import bm25_sql, documents, symbols, table, with_symbols
from lodestone.plans.registry import query
from lodestone.plans.vector_queries import _NEAR

TOP = " SELECT doc_id, round(score, 6) AS score FROM (SELECT * FROM scored ORDER BY score DESC, doc_id LIMIT 20)"
OLD_TEXT = "the old ention "


def older(spark, d):
    """What documents held before: some texts were others, some rows were not there yet, and some rows are gone since."""
    rows = documents(spark, d)
    text = F.when(F.col("doc_id") % 7 == 0, F.lit(OLD_TEXT)).otherwise(F.col("text")).alias("text")
    return rows.where("doc_id % 11 <> 3").select("doc_id", text).unionByName(rows.where("doc_id % 13 = 0").select((-1 - F.col("doc_id")).alias("doc_id"), "text"))


def segmented(spark, d) -> SegmentedIndex:
    """An index of the older rows, brought in step with documents."""

    def build(path):
        index = SegmentedIndex(spark, path, "doc_id", ["text"])
        index.update(older(spark, d))
        index.sync(documents(spark, d))

    return SegmentedIndex(spark, fulltext.built_once(spark, "documents in segments", f"{d}/documents.parquet", build), "doc_id", ["text"])


def scores(found):
    return found.select(F.col("doc").alias("doc_id"), F.round("score", 6).alias("score"))


@query("f02_index_update", "WITH " + bm25_sql("documents", "doc_id", {"text": 1.0}, [(["ention"], True), (["the"], True)], "n0 AND n1") + " SELECT doc_id, round(score, 6) AS score FROM scored")
def f02_update(spark, d):
    return scores(segmented(spark, d).search({"text": 1.0}, fulltext.plan_query("ention the")))


@query("a08_index_changes", """SELECT doc_id, CASE WHEN doc_id % 11 = 3 THEN 'gone' ELSE 'changed' END AS state FROM documents WHERE doc_id % 11 = 3 OR doc_id % 7 = 0
  UNION ALL SELECT -1 - doc_id, 'new' FROM documents WHERE doc_id % 13 = 0""")
def a08_changes(spark, d):
    """How the older rows differ from the index, which holds the present ones."""
    return segmented(spark, d).difference(older(spark, d)).select(F.col("doc").alias("doc_id"), "state")


@query("f08_bm25_topk", "WITH " + bm25_sql("documents", "doc_id", {"text": 1.0}, [(["ention"], True)], "n0") + TOP)
def f08_topk(spark, d):
    return scores(segmented(spark, d).find_top({"text": 1.0}, "ention", 20))


@query("f08_bm25_topk_any", "WITH " + bm25_sql("documents", "doc_id", {"text": 1.0}, [(["ciones"], True), (["zzzqqq"], True), (["heit"], True)], "n0 OR n1 OR n2") + " SELECT doc_id, round(score * 0.5, 6) AS score FROM (SELECT * FROM scored ORDER BY score DESC, doc_id LIMIT 20)")
def f08_topk_any(spark, d):
    return scores(segmented(spark, d).find_top({"text": 1.0}, "ciones zzzqqq heit", 20))


def symbol_grams(spark, d) -> str:
    return fulltext.built_once(spark, "trigrams of symbols", f"{d}/part.parquet", lambda path: grams.build_grams(symbols(spark, d), "id", ["title", "abstract"], path))


def document_grams(spark, d) -> str:
    return fulltext.built_once(spark, "trigrams of documents", f"{d}/documents.parquet", lambda path: grams.build_grams(documents(spark, d), "doc_id", ["text"], path))


def _wildcard(glob: str, like: str):
    sql = with_symbols(f""" SELECT id, title, round(score, 6) AS score FROM (
      SELECT id, title, CASE WHEN tm THEN 10.0::DOUBLE ELSE 1.0::DOUBLE END + CASE WHEN is_primary THEN 5.0::DOUBLE ELSE 0 END - least(5.0::DOUBLE, length(title) * 0.1::DOUBLE) AS score
      FROM (SELECT *, title ILIKE '{like}' AS tm FROM sym) WHERE tm OR abstract ILIKE '{like}' ORDER BY tm DESC, is_primary DESC, length(title), title, id LIMIT 20)""")

    def run(spark, d):
        return grams.wildcard(symbols(spark, d), symbol_grams(spark, d), glob, "id").select("id", "title", F.round("score", 6).alias("score"))

    return sql, run


for _name, _glob, _like in (("f11_gram_prefix", "red*", "red%"), ("f11_gram_infix", "*d ge*", "%d ge%"), ("f11_gram_char", "?ld*", "_ld%")):
    _sql, _run = _wildcard(_glob, _like)
    query(_name, _sql)(_run)


@query("f12_gram_titles", with_symbols(" SELECT id, title, 1.0::DOUBLE AS score FROM sym WHERE title ILIKE 'c_ld%' ORDER BY is_primary DESC, length(title), id LIMIT 20"))
def f12_gram(spark, d):
    return grams.wildcard_titles(symbols(spark, d), symbol_grams(spark, d), "c?ld*", "id").select("id", "title", "score")


@query("f13_gram_substring", "SELECT doc_id, 1.0::DOUBLE AS score FROM documents WHERE contains(lower(text), 'nthe') ORDER BY doc_id LIMIT 20")
def f13_gram(spark, d):
    return grams.substring(documents(spark, d), document_grams(spark, d), "NThe", "doc_id", ("text",)).select("doc_id", "score")


@query("f13_gram_short", "SELECT doc_id, 1.0::DOUBLE AS score FROM documents WHERE contains(lower(text), 'ß.') ORDER BY doc_id LIMIT 20")
def f13_short(spark, d):
    return grams.substring(documents(spark, d), document_grams(spark, d), "ß.", "doc_id", ("text",)).select("doc_id", "score")


@query("f16_gram_fallback", with_symbols(" SELECT id FROM sym WHERE contains(lower(title), 'gizmo') OR contains(lower(abstract), 'gizmo') ORDER BY id LIMIT 50"))
def f16_gram(spark, d):
    return grams.substring(symbols(spark, d), symbol_grams(spark, d), "gizmo", "id", ("title", "abstract"), 50).select("id")


def symbol_names(spark, d) -> str:
    return f"{fulltext.built_once(spark, 'names of symbols', f'{d}/part.parquet', lambda path: resolve.name_index(symbols(spark, d), f'{path}/variants'))}/variants"


@query("r03_fuzzy_titles", """WITH t AS (SELECT DISTINCT p_name AS title FROM part), names AS (SELECT title AS name FROM t UNION SELECT replace(title, ' ', '-') FROM t),
  q AS (SELECT DISTINCT substr(title, 1, 1) || substr(title, 3) AS query FROM t)
  SELECT query, name, damerau_levenshtein(name, query) AS distance FROM q, names WHERE damerau_levenshtein(name, query) <= CASE WHEN length(query) <= 4 THEN 1 WHEN length(query) <= 8 THEN 2 ELSE 3 END""")
def r03_titles(spark, d):
    """Every title without its second letter, against all titles and last path segments."""
    typos = symbols(spark, d).select(F.concat(F.substring("title", 1, 1), F.substring("title", 3, 1 << 30)).alias("query"))
    return fuzzy.close_names(typos, "query", symbol_names(spark, d)).select("query", "name", F.col("distance").cast("long").alias("distance"))


# The longest common block, of those the first in the title and then in the query; then the same before and behind it.
_BLOCKS = """WITH RECURSIVE t AS (SELECT p_name AS title, min(p_partkey) AS id FROM part WHERE p_type IN ('ECONOMY', 'PROMO') GROUP BY p_name), q AS (SELECT DISTINCT substr(p_name, 2, 1) || substr(p_name, 1, 1) || substr(p_name, 3) || 'x' AS query FROM part),
  pieces AS (SELECT query, title, id, title AS a, query AS b, 0 AS common FROM q, t
    UNION ALL SELECT query, title, id, CASE WHEN side = 0 THEN substr(a, 1, best.i - 1) ELSE substr(a, best.i + best.l) END, CASE WHEN side = 0 THEN substr(b, 1, best.j - 1) ELSE substr(b, best.j + best.l) END, CASE WHEN side = 0 THEN best.l ELSE 0 END
    FROM (SELECT *, list_sort(list_filter(flatten(list_transform(range(1, length(a) + 1), lambda i: list_transform(range(1, length(a) - i + 2), lambda l: {'l': l, 'n': -i, 'i': i, 'j': strpos(b, substr(a, i, l))}))), lambda m: m.j > 0), 'DESC')[1] AS best FROM pieces WHERE a <> '' AND b <> ''), (VALUES (0), (1)) s(side)
    WHERE best IS NOT NULL),
  ratios AS (SELECT query, title, id, 2.0::DOUBLE * sum(common) / (length(query) + length(title)) AS ratio FROM pieces GROUP BY query, title, id)
"""


@query("r02_close_titles", _BLOCKS + " SELECT query, title, id, round(ratio, 6) AS ratio, place FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY ratio DESC, title) AS place FROM ratios WHERE ratio >= 0.65) WHERE place <= 4")
def r02_close(spark, d):
    """Every title with its first letters swapped and a letter added, against all primary titles."""
    rest = F.concat(F.substring("title", 2, 1), F.substring("title", 1, 1), F.substring("title", 3, 1 << 30), F.lit("x"))
    found = resolve.close_titles(symbols(spark, d), symbols(spark, d).select(rest.alias("query")))
    return found.select("query", "title", "id", F.round("ratio", 6).alias("ratio"), F.col("place").cast("long").alias("place"))


@query("r03_fuzzy_index", with_symbols(""" SELECT title, framework, distance FROM (
  SELECT title, framework, path, is_primary, damerau_levenshtein(lower(title), 'smal rign') AS distance FROM (SELECT DISTINCT ON (framework, path) * FROM sym ORDER BY framework, path, id) WHERE abs(length(title) - 9) <= 3 OR is_primary OR contains(path, '/smal rign'))
  WHERE distance <= 3 ORDER BY distance, is_primary DESC, length(title), title, framework, path LIMIT 3"""))
def r03_index(spark, d):
    first = filters.keep_first(symbols(spark, d), ["framework", "path"], [F.col("id")])
    return resolve.suggestions(first, "smal rign", index=symbol_names(spark, d)).select("title", "framework", F.col("distance").cast("long").alias("distance"))


@query("v05_knn_cells", f"WITH {_NEAR} SELECT qid, vec_id, round(sim, 5) AS sim, place FROM r WHERE place <= 10")
def v05_cells(spark, d):
    rows = table(spark, d, "embeddings")
    path = fulltext.built_once(spark, "cells of embeddings", f"{d}/embeddings.parquet", lambda path: cells.build_cells(rows, "vec_id", path))
    queries = rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"))
    found, _ = cells.nearest_in_cells(spark, path, queries, 10)
    return found.select("qid", F.col("id").alias("vec_id"), F.round("sim", 5).alias("sim"), F.col("place").cast("long").alias("place"))


@query("x01_expand_all", r"""WITH rules AS (SELECT item_id, regexp_extract(text, '^[^ \n]+ [^ \n]+', 0) AS term FROM benchmark), r AS (SELECT item_id, term, trim(regexp_replace(lower(term), '[^a-z0-9_]+', ' ', 'g')) AS phrase FROM rules WHERE term <> ''),
  q AS (SELECT lower(trim(text, ' ')) AS low, regexp_replace(lower(trim(text, ' ')), '[^a-z0-9_]+', ' ', 'g') AS clean FROM documents WHERE trim(text, ' ') <> '')
  SELECT r.item_id AS rule, count(*) AS n FROM r JOIN q ON contains(low, lower(term)) OR (phrase <> '' AND contains(clean, phrase)) GROUP BY r.item_id""")
def x01_all(spark, d):
    """How many documents hold the first two words of each benchmark item, in one pass over their texts."""
    term = F.regexp_extract("text", r"^[^ \n]+ [^ \n]+", 0)
    none = F.array().cast("array<string>")
    rules = table(spark, d, "benchmark").select("item_id", term.alias("term")).where("term <> ''")
    rules = rules.select(F.col("item_id").alias("rule"), F.array("term").alias("terms"), F.lit(False).alias("case_sensitive"), none.alias("symbols"), none.alias("frameworks"), F.lit(0).alias("place"))
    met = fusion.expand_all(documents(spark, d).select(F.col("doc_id").alias("qid"), F.col("text").alias("query")), rules)
    return met.groupBy("rule").agg(F.count("*").alias("n"))


def symbol_completions(spark, d) -> str:
    return fulltext.built_once(spark, "completions of symbols", f"{d}/part.parquet", lambda path: complete.build_completions(symbols(spark, d), "title", "id", "is_primary", f"{path}/c")) + "/c"


_LABELS = """, l AS (SELECT title AS label, bool_or(is_primary) AS is_primary, coalesce(min(id) FILTER (is_primary), min(id)) AS id FROM sym GROUP BY title),
  w AS (SELECT *, list_filter(string_split(lower(label), ' '), lambda x: x <> '') AS words FROM l), s AS (SELECT DISTINCT label, is_primary, id, array_to_string(words[i:], ' ') AS start FROM w, unnest(range(1, len(words) + 1)) t(i))"""


@query("f17_prefixes", with_symbols(_LABELS + """, p AS (SELECT DISTINCT label, is_primary, id, substr(start, 1, n) AS prefix FROM s, range(1, 7) t(n) WHERE n <= length(start))
  SELECT prefix, place, label, id FROM (SELECT *, row_number() OVER (PARTITION BY prefix ORDER BY is_primary DESC, length(label), label) AS place FROM p) WHERE place <= 8"""))
def f17_prefixes(spark, d):
    """The completions of every prefix of up to six letters."""
    return complete.stored_prefixes(spark, symbol_completions(spark, d)).withColumn("place", F.col("place").cast("long"))


@query("f17_complete", with_symbols(_LABELS + """, r AS (SELECT 'rule' AS source, r_name AS label, NULL::BIGINT AS id, row_number() OVER (ORDER BY r_regionkey) - 3 AS o FROM region WHERE contains(lower(r_name), 'r') QUALIFY o <= 0),
  b AS (SELECT 'title' AS source, label, id, row_number() OVER (ORDER BY is_primary DESC, length(label), label) AS o FROM (SELECT DISTINCT label, is_primary, id FROM s WHERE starts_with(start, 'r')) QUALIFY o <= 8)
  SELECT source, label, id, row_number() OVER (ORDER BY o) AS place FROM (SELECT * FROM r UNION ALL SELECT * FROM b) QUALIFY place <= 8"""))
def f17_complete(spark, d):
    """Completions of one letter, region names in the place of rules."""
    rules = table(spark, d, "region").select(F.col("r_regionkey").alias("place"), F.col("r_name").alias("label"))
    return complete.complete(spark, symbol_completions(spark, d), "R", first=rules).withColumn("place", F.col("place").cast("long"))


@query("f17_complete_long", with_symbols(_LABELS + """ SELECT 'title' AS source, label, id, row_number() OVER (ORDER BY is_primary DESC, length(label), label) AS place FROM (SELECT DISTINCT label, is_primary, id FROM s WHERE starts_with(start, 'small ri')) QUALIFY place <= 8"""))
def f17_long(spark, d):
    """Completions of more letters than prefixes are stored for."""
    return complete.complete(spark, symbol_completions(spark, d), "Small  ri").withColumn("place", F.col("place").cast("long"))
