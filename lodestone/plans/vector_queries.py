"""Vector search, expansion and fusion."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone.functions import vectors as V
from lodestone.operators import fulltext, fusion, vectorsearch
from lodestone.operators.fulltext import Phrase
from lodestone.plans.bindings import bm25_sql, document_index, symbols, table, with_symbols
from lodestone.plans.registry import query


def first_vector(spark, d):
    """The query vector of these tests: one row, a point lookup."""
    return table(spark, d, "embeddings").where("vec_id = 0").select("embedding").first()[0]


DOUBLES = "CAST(embedding AS DOUBLE[])"
_Q = f"q AS (SELECT {DOUBLES} AS qv FROM embeddings WHERE vec_id = 0)"
_SIM = f"list_cosine_similarity({DOUBLES}, qv)"


@query("v01_cosine", f"WITH {_Q} SELECT vec_id, round({_SIM}, 6) AS sim FROM embeddings, q")
def v01(spark, d):
    return vectorsearch.similar(table(spark, d, "embeddings"), first_vector(spark, d)).select("vec_id", F.round("sim", 6).alias("sim"))


@query("v03_normalise", f"SELECT vec_id, round(sqrt(list_sum(list_transform({DOUBLES}, lambda x: x * x))), 5) AS norm, CAST(1 AS DOUBLE) AS after FROM embeddings")
def v03(spark, d):
    rows = vectorsearch.with_norms(table(spark, d, "embeddings"))
    return rows.select("vec_id", F.round("norm", 5).alias("norm"), F.round(V.norm(V.l2_normalize(F.col("embedding"))), 6).alias("after"))


@query("v05_knn", f"WITH {_Q} SELECT vec_id, round(sim, 6) AS sim FROM (SELECT vec_id, {_SIM} AS sim FROM embeddings, q ORDER BY sim DESC, vec_id LIMIT 20)")
def v05(spark, d):
    return vectorsearch.nearest(table(spark, d, "embeddings"), first_vector(spark, d), "vec_id", 20).select("vec_id", F.round("sim", 6).alias("sim"))


@query("v05_knn_label", f"WITH {_Q} SELECT vec_id, round(sim, 6) AS sim FROM (SELECT vec_id, {_SIM} AS sim FROM embeddings, q WHERE label = 3 ORDER BY sim DESC, vec_id LIMIT 20)")
def v05_label(spark, d):
    return vectorsearch.nearest(table(spark, d, "embeddings"), first_vector(spark, d), "vec_id", 20, where=F.col("label") == 3).select("vec_id", F.round("sim", 6).alias("sim"))


@query("v06_threshold", f"WITH {_Q} SELECT vec_id, round(sim, 6) AS sim FROM (SELECT vec_id, {_SIM} AS sim FROM embeddings, q) WHERE sim >= 0.2 ORDER BY sim DESC, vec_id LIMIT 20")
def v06(spark, d):
    return vectorsearch.nearest(table(spark, d, "embeddings"), first_vector(spark, d), "vec_id", 20, floor=0.2).select("vec_id", F.round("sim", 6).alias("sim"))


@query("v07_width_hist", "SELECT CAST(len(embedding) AS INTEGER) AS dims, count(*) AS n FROM embeddings GROUP BY 1")
def v07(spark, d):
    return vectorsearch.width_histogram(table(spark, d, "embeddings"))


@query("v10_widths", "SELECT DISTINCT CAST(len(embedding) AS INTEGER) AS dims FROM embeddings")
def v10(spark, d):
    return table(spark, d, "embeddings").select(F.size("embedding").alias("dims")).distinct()


@query("v11_missing_vectors", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def v11(spark, d):
    return vectorsearch.missing_vectors(table(spark, d, "documents").select("doc_id"), table(spark, d, "embeddings"), "doc_id", "vec_id")


@query("v12_embed_text", with_symbols(" SELECT id, CASE WHEN trim(abstract) <> '' THEN trim(abstract) ELSE title || ' — ' || kind || ' in ' || framework || '.' END AS text FROM sym"))
def v12(spark, d):
    return symbols(spark, d).select("id", vectorsearch.embed_text(F.col("title"), F.col("kind"), F.col("framework"), F.col("abstract")).alias("text"))


@query("v13_prompts", with_symbols(" SELECT id, 'task: search result | query: ' || title AS q, 'title: ' || title || ' | text: ' || abstract AS doc FROM sym"))
def v13(spark, d):
    once = vectorsearch.prompt_query(F.col("title"))
    return symbols(spark, d).select("id", vectorsearch.prompt_query(once).alias("q"), vectorsearch.prompt_document(F.col("title"), F.col("abstract")).alias("doc"))


@query("v14_embed_missing", "SELECT count(*) AS embedded, CASE WHEN count(*) > 0 THEN CAST(16 AS INTEGER) END AS dims FROM (SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings))")
def v14(spark, d):
    from lodestone.sources.embedder import embed

    todo = vectorsearch.missing_vectors(table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "embeddings"), "doc_id", "vec_id")
    return embed(todo, "doc_id", "text", 16).agg(F.count("*").alias("embedded"), F.max(F.size("embedding")).alias("dims"))


@query("v18_plain_id", "SELECT p_partkey AS id, CAST(p_partkey AS VARCHAR) AS plain FROM part")
def v18(spark, d):
    return symbols(spark, d).select("id", vectorsearch.plain_id(F.concat(F.lit("sym-"), F.col("id").cast("string"))).alias("plain"))


_NEAR = f"""qs AS (SELECT vec_id AS qid, label AS ql, {DOUBLES} AS qv FROM embeddings WHERE vec_id % 20 = 0),
  r AS (SELECT qid, ql, vec_id, label, {_SIM} AS sim, row_number() OVER (PARTITION BY qid ORDER BY {_SIM} DESC, vec_id) AS place FROM embeddings, qs WHERE vec_id <> qid)"""


def _near(spark, d, k):
    """The k nearest rows of every row whose id is divisible by 20, with whether their labels agree."""
    rows = table(spark, d, "embeddings")
    own = rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), F.col("label").alias("ql"), F.col("embedding").alias("qvec"))
    near = vectorsearch.nearest_by_row(rows, own, "vec_id", k)
    return near.join(rows.select("vec_id", "label"), "vec_id").join(own.select("qid", "ql"), "qid").withColumn("relevant", F.col("label") == F.col("ql"))


@query("v05_knn_rows", f"WITH {_NEAR} SELECT qid, vec_id, round(sim, 5) AS sim, place FROM r WHERE place <= 10")
def v05_rows(spark, d):
    return _near(spark, d, 10).select("qid", "vec_id", F.round("sim", 5).alias("sim"), F.col("place").cast("long").alias("place"))


@query("v19_mrr_recall", f"""WITH {_NEAR}, f AS (SELECT qid, coalesce(min(place) FILTER (label = ql AND place <= 100), 1000000000) AS rank FROM r GROUP BY qid)
  SELECT count(*) AS queries, round(avg(1.0::DOUBLE / rank), 6) AS mrr, avg(CAST(rank <= 1 AS INTEGER)) AS recall_1, avg(CAST(rank <= 3 AS INTEGER)) AS recall_3, avg(CAST(rank <= 5 AS INTEGER)) AS recall_5 FROM f""")
def v19(spark, d):
    first = _near(spark, d, 100).groupBy("qid").agg(F.coalesce(F.min(F.when(F.col("relevant"), F.col("place"))), F.lit(1_000_000_000)).alias("rank"))
    return vectorsearch.retrieval_quality(first).withColumn("mrr", F.round("mrr", 6))


@query("v19_margin", f"WITH {_NEAR}, m AS (SELECT qid, max(sim) FILTER (label = ql) AS t, max(sim) FILTER (label <> ql) AS o FROM r WHERE place <= 100 GROUP BY qid) SELECT round(avg(t), 5) AS target, round(avg(o), 5) AS distractor, round(avg(t - o), 5) AS margin FROM m")
def v19_margin(spark, d):
    return vectorsearch.margins(_near(spark, d, 100)).select(*(F.round(c, 5).alias(c) for c in ("target", "distractor", "margin")))


RULES = [
    (0, "shared thing", ["shared thing", "thing: shared"], False, ["@Gear", "Ring(size:)"], ["Core"]),
    (1, "onesen", ["onesen", "thonthis"], False, ["Bolt"], ["UI"]),
    (2, "Mentre", ["Mentre", "heention"], True, ["Plate", "Gear"], ["_Hidden"]),
    (3, "that the", ["that the"], False, ["Widget"], ["UI", "Core"]),
]


def rules(spark):
    return spark.createDataFrame(RULES, "place int, rule string, terms array<string>, case_sensitive boolean, symbols array<string>, frameworks array<string>")


_NORM = "regexp_replace(lower(text), '[^a-z0-9_]+', ' ', 'g')"


def _word(term: str, flags: str) -> str:
    return rf"regexp_matches(text, '(^|\b|\W){term}(\b|\W|$)'{flags})"


_MET = f"""met AS (
  SELECT item_id AS qid, 0 AS place, 'shared thing' AS rule, ['Gear', 'Ring'] AS names FROM benchmark WHERE contains(lower(text), 'shared thing') OR contains({_NORM}, 'shared thing') OR contains(lower(text), 'thing: shared') OR contains({_NORM}, 'thing shared')
  UNION ALL SELECT item_id, 1, 'onesen', ['Bolt'] FROM benchmark WHERE {_word('onesen', ", 'i'")} OR {_word('thonthis', ", 'i'")}
  UNION ALL SELECT item_id, 2, 'Mentre', ['Plate', 'Gear'] FROM benchmark WHERE {_word('Mentre', '')} OR {_word('heention', ", 'i'")}
  UNION ALL SELECT item_id, 3, 'that the', ['Widget'] FROM benchmark WHERE contains(lower(text), 'that the') OR contains({_NORM}, 'that the'))"""


@query("x01_expand", f"WITH {_MET} SELECT qid, rule, array_to_string(names, ',') AS names FROM met")
def x01(spark, d):
    queries = table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))
    met = fusion.expand(queries, rules(spark))
    clean = F.transform("symbols", lambda s: F.regexp_replace(F.regexp_replace(s, "^@", ""), r"\(.*$", ""))
    return met.select("qid", "rule", F.array_join(clean, ",").alias("names"))


@query("x01_mapped", f"WITH {_MET} SELECT qid, string_agg(n, ',' ORDER BY o) AS mapped FROM (SELECT qid, n, min(place * 10 + i) AS o FROM (SELECT qid, place, unnest(names) AS n, generate_subscripts(names, 1) AS i FROM met) GROUP BY qid, n) GROUP BY qid")
def x01_mapped(spark, d):
    queries = table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))
    return fusion.mapped_symbols(fusion.expand(queries, rules(spark))).select("qid", F.array_join("mapped", ",").alias("mapped"))


@query("x02_intents", rf"SELECT item_id AS qid, 'both' AS intent FROM benchmark WHERE (list_contains(string_split(trim({_NORM}), ' '), 'the') OR contains(lower(text), 'the')) AND (list_contains(string_split(trim({_NORM}), ' '), 'is') OR contains(lower(text), 'is'))")
def x02(spark, d):
    queries = table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))
    intents = spark.createDataFrame([("both", ["the", "is"], ["Gear"])], "intent string, words array<string>, tokens array<string>")
    return fusion.intents(queries, intents).select("qid", "intent")


def _lists(spark, d):
    lexical = fulltext.search_index(spark, document_index(spark, d), {"text": 1.0}, [[Phrase.of("ention")]]).select(F.col("doc").alias("doc_id"), "score").orderBy(F.col("score").desc(), "doc_id").limit(20)
    near = vectorsearch.nearest(table(spark, d, "embeddings"), first_vector(spark, d), "vec_id", 20).select(F.col("vec_id").alias("doc_id"), F.col("sim").alias("score"))
    order = [F.col("score").desc(), F.col("doc_id")]
    return fusion.ranked(lexical, order), fusion.ranked(near, order)


def _rrf_sql(a: float, b: float) -> str:
    return "WITH " + bm25_sql("documents", "doc_id", {"text": 1.0}, [(["ention"], True)], "n0") + f""", {_Q},
  l AS (SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id) - 1 AS rank FROM (SELECT * FROM scored ORDER BY score DESC, doc_id LIMIT 20)),
  s AS (SELECT doc_id, sim AS score, row_number() OVER (ORDER BY sim DESC, doc_id) - 1 AS rank FROM (SELECT vec_id AS doc_id, {_SIM} AS sim FROM embeddings, q ORDER BY sim DESC, vec_id LIMIT 20))
  SELECT doc_id, round(coalesce(l.score, s.score), 6) AS score, round(coalesce({a}::DOUBLE / (61 + l.rank), 0) + coalesce({b}::DOUBLE / (61 + s.rank), 0), 9) AS rrf,
    CASE WHEN s.rank IS NULL THEN 'fts' WHEN l.rank IS NULL THEN 'semantic' ELSE 'hybrid' END AS source FROM l FULL OUTER JOIN s USING (doc_id)"""


@query("x04_rrf_hybrid", _rrf_sql(1.0, 1.0))
def x04(spark, d):
    out = fusion.fuse(*_lists(spark, d), "doc_id")
    return out.select("doc_id", F.round("score", 6).alias("score"), F.round("rrf", 9).alias("rrf"), "source")


@query("x04_rrf_semantic", _rrf_sql(0.7, 1.8))
def x04_semantic(spark, d):
    out = fusion.fuse(*_lists(spark, d), "doc_id", 0.7, 1.8)
    return out.select("doc_id", F.round("score", 6).alias("score"), F.round("rrf", 9).alias("rrf"), "source")
