"""End-to-end searches, lookups, rendering and logs."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from lodestone.functions import logs, markup
from lodestone.operators import hybrid
from lodestone.plans.bindings import bm25_sql, symbol_index, symbols, table, with_symbols
from lodestone.plans.registry import query
from lodestone.plans.search_queries import FLAT, WIDE
from lodestone.plans.vector_queries import DOUBLES, RULES, first_vector, rules
from lodestone.streaming import jobs


def _vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.concat(F.lit("Brand#"), F.col("label").cast("string")).alias("framework"), "embedding")


def lexical_sql(words: list[str], most: int, limit: int) -> str:
    """SQL of a search for all words as prefixes that some row meets: the best `most`, boosted where the title is the query, the best `limit` of them."""
    match = " AND ".join(f"n{i}" for i in range(len(words)))
    return with_symbols(", ") + bm25_sql("sym", "id", WIDE, [([w], True) for w in words], match, ("title",)) + f""" SELECT id, title, round(score + CASE WHEN lower(title) = '{' '.join(words)}' THEN 100.0::DOUBLE ELSE 0 END, 6) AS score
  FROM (SELECT * FROM scored ORDER BY score DESC, id LIMIT {most}) ORDER BY score DESC, id LIMIT {limit}"""


def hybrid_sql(words: list[str], limit: int) -> str:
    """SQL of the same search fused with the rows next to the first vector."""
    match = " AND ".join(f"n{i}" for i in range(len(words)))
    return with_symbols(", ") + bm25_sql("sym", "id", WIDE, [([w], True) for w in words], match) + f""", q AS (SELECT {DOUBLES} AS qv FROM embeddings WHERE vec_id = 0),
  l AS (SELECT id, score, row_number() OVER (ORDER BY score DESC, id) - 1 AS rank FROM (SELECT id, score + CASE WHEN id IN (SELECT id FROM sym WHERE lower(title) = '{' '.join(words)}') THEN 100.0::DOUBLE ELSE 0 END AS score FROM (SELECT * FROM scored ORDER BY score DESC, id LIMIT {4 * limit}))),
  s AS (SELECT id, sim * 50 AS score, row_number() OVER (ORDER BY sim DESC, id) - 1 AS rank FROM (SELECT vec_id AS id, list_cosine_similarity({DOUBLES}, qv) AS sim FROM embeddings, q) WHERE sim >= 0.1 QUALIFY row_number() OVER (ORDER BY sim DESC, id) <= {2 * limit}),
  f AS (SELECT id, coalesce(l.score, s.score) AS score, coalesce(1.0::DOUBLE / (61 + l.rank), 0) + coalesce(1.0::DOUBLE / (61 + s.rank), 0) AS rrf, CASE WHEN s.rank IS NULL THEN 'fts' WHEN l.rank IS NULL THEN 'semantic' ELSE 'hybrid' END AS source FROM l FULL OUTER JOIN s USING (id)),
  c AS (SELECT * FROM f ORDER BY rrf DESC, score DESC, id LIMIT {2 * limit})
  SELECT c.id, title, round(score, 6) AS score, round(rrf, 9) AS rrf, source FROM c JOIN sym USING (id) ORDER BY rrf DESC, score DESC, c.id LIMIT {limit}"""


@query("x06_hybrid_search", hybrid_sql(["red", "gear"], 10))
def x06(spark, d):
    out = hybrid.search(symbols(spark, d), _vectors(spark, d), "red gear", first_vector(spark, d), limit=10, floor=0.1, index=symbol_index(spark, d))
    return out.select("id", "title", F.round("score", 6).alias("score"), F.round("rrf", 9).alias("rrf"), "source")


@query("x06_lexical_gate", with_symbols(", ") + bm25_sql("sym", "id", WIDE, [(["red"], True), (["gear"], True)], "n0 AND n1", ("title",)) + " SELECT id, round(score + CASE WHEN lower(title) = 'red gear' THEN 100.0::DOUBLE ELSE 0 END, 6) AS score FROM (SELECT * FROM scored ORDER BY score DESC, id LIMIT 40) ORDER BY score DESC, id LIMIT 10")
def x06_gate(spark, d):
    out = hybrid.search(symbols(spark, d), _vectors(spark, d).limit(50), "red gear", first_vector(spark, d), limit=10, index=symbol_index(spark, d))
    return out.select("id", F.round("score", 6).alias("score"))


def name_rules(spark):
    """A rule that the query meets by its phrase, one it does not meet, and an intent."""
    kind = "place int, rule string, terms array<string>, case_sensitive boolean, symbols array<string>, frameworks array<string>"
    rules_ = spark.createDataFrame([(0, "round part", ["round part"], False, ["@gear", "ring(x:)"], ["Core"]), (1, "flat part", ["flat part"], False, ["bolt"], ["Core"])], kind)
    return rules_, spark.createDataFrame([("paint", ["blue", "part"], ["blue plate"])], "intent string, words array<string>, tokens array<string>")


def _hits(token: str, n: int) -> str:
    """CTEs of one prefix search over symbols under names of its own: h{n} (id, score)."""
    names = {"tok": f"tok{n}", "counted": f"counted{n}", "stats": f"stats{n}", "flagged": f"flagged{n}", "scored": f"scored{n}"}
    sql = bm25_sql("sym", "id", WIDE, [([token], True)], "n0")
    for a, b in names.items():
        sql = re.sub(rf"\b{a}\b", b, sql)
    return sql


_INJECT = with_symbols(", ") + ", ".join(_hits(t, n) for n, t in enumerate(("old", "gear", "ring"))) + """,
  a AS (SELECT id, score FROM scored0 ORDER BY score DESC, id LIMIT 40),
  x AS (SELECT id, 1000.0::DOUBLE AS score FROM sym WHERE lower(title) = 'old' ORDER BY is_primary DESC, id LIMIT 5),
  a2 AS (SELECT * FROM x UNION ALL SELECT * FROM a WHERE id NOT IN (SELECT id FROM x)),
  b AS (SELECT id, score * 0.9::DOUBLE AS score FROM (SELECT id, score FROM scored1 ORDER BY score DESC, id LIMIT 20) WHERE id NOT IN (SELECT id FROM a2)),
  c AS (SELECT id, score * 0.9::DOUBLE AS score FROM (SELECT id, score FROM scored2 ORDER BY score DESC, id LIMIT 20) WHERE id NOT IN (SELECT id FROM a2 UNION ALL SELECT id FROM b)),
  u AS (SELECT * FROM a2 UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c)
  SELECT id, round(score + CASE WHEN lower(title) = 'old' THEN 100.0::DOUBLE ELSE 0 END + CASE WHEN lower(title) IN ('gear', 'ring') THEN 50.0::DOUBLE ELSE 0 END, 6) AS score FROM u JOIN sym USING (id)"""


@query("x03_injection", _INJECT)
def x03(spark, d):
    mapped = hybrid.mapped_names("a round part", name_rules(spark)[0])
    return hybrid.lexical(symbols(spark, d), "old", 40, mapped, index=symbol_index(spark, d)).select("id", F.round("score", 6).alias("score"))


def _any_list(token: str, n: int, most: int) -> str:
    words = token.split()
    sql = bm25_sql("sym", "id", FLAT, [([w], True) for w in words], " OR ".join(f"n{i}" for i in range(len(words))), ("title", "is_primary"))
    for a in ("tok", "counted", "stats", "flagged", "scored"):
        sql = re.sub(rf"\b{a}\b", f"{a}{n}", sql)
    return sql + f""", l{n} AS (SELECT id, tier, row_number() OVER (ORDER BY tier, rank, id) - 1 AS rank FROM (SELECT id, CASE WHEN lower(title) = '{token}' THEN 0 WHEN starts_with(lower(title), '{token}(') THEN 1 WHEN starts_with(lower(title), 'func {token}(') THEN 2 ELSE 3 END AS tier,
      -score - 4.0::DOUBLE * CAST(is_primary AS INTEGER) AS rank FROM scored{n}) QUALIFY row_number() OVER (ORDER BY tier, rank, id) <= {most})"""


@query("x05_rrf_lists", with_symbols(", ") + ", ".join(_any_list(t, n, m) for n, (t, m) in enumerate((("gear", 8), ("ring", 8), ("blue plate", 8), ("blue round part", 20)))) + """,
  u AS (SELECT id, rank, 1.35::DOUBLE AS w FROM l0 UNION ALL SELECT id, rank, 1.35 FROM l1 UNION ALL SELECT id, rank, 1.35 FROM l2 UNION ALL SELECT id, rank, CASE WHEN tier = 0 THEN 1.5 ELSE 1.0 END FROM l3),
  s AS (SELECT id, round(sum(w / (61 + rank)), 5) AS rrf, count(*) AS lists FROM u GROUP BY id)
  SELECT id, title, rrf, lists FROM s JOIN sym USING (id) ORDER BY rrf DESC, is_primary DESC, id LIMIT 10""")
def x05(spark, d):
    return hybrid.ranked_tokens(symbols(spark, d), "blue round part", *name_rules(spark), index=symbol_index(spark, d))


_PAGES = "SELECT DISTINCT path, 'about ' || path AS content FROM sym WHERE id % 2 = 0"


def _pages(rows):
    return rows.where("id % 2 = 0").select("path", F.concat(F.lit("about "), "path").alias("content")).distinct()


@query("g05_lookup", with_symbols(f", p AS ({_PAGES}), t AS (SELECT path AS target FROM sym WHERE id = 3), o AS (SELECT * FROM sym, t WHERE path = target ORDER BY is_primary DESC, id LIMIT 1) SELECT id, content, CASE WHEN content IS NULL THEN 'catalogue' ELSE 'page' END AS origin FROM o LEFT JOIN p ON o.path = p.path"))
def g05(spark, d):
    rows = symbols(spark, d)
    target = rows.where("id = 3").first()["path"]
    return hybrid.lookup(rows, _pages(rows), target).select("id", "content", "origin")


@query("g10_reference", with_symbols(" SELECT id, CAST(1 AS INTEGER) AS step FROM sym WHERE path = '/documentation/' || (SELECT split_part(path, '/', 3) || '/' || split_part(path, '/', 4) FROM sym WHERE id = 5) AND id = (SELECT id FROM sym s WHERE s.path = (SELECT path FROM sym WHERE id = 5) ORDER BY is_primary DESC, id LIMIT 1)"))
def g10(spark, d):
    rows = symbols(spark, d)
    target = rows.where("id = 5").first()["path"]
    return hybrid.reference(rows, _pages(rows), _vectors(spark, d), target).select("id", F.col("step").cast("int").alias("step"))


_SHOWCASE = " UNION ALL ".join(f"SELECT '{part}' AS part, id, title FROM ({sql})" for part, sql in (
    ("wildcard", with_symbols(" SELECT id, title FROM sym WHERE title ILIKE 'red%' OR abstract ILIKE 'red%' ORDER BY (title ILIKE 'red%') DESC, is_primary DESC, length(title), title, id LIMIT 5")),
    ("lexical", lexical_sql(["blue", "bolt"], 20, 5)),
    ("hybrid", hybrid_sql(["old", "ring"], 5)),
))


@query("g07_showcase", _SHOWCASE)
def g07(spark, d):
    rows = symbols(spark, d)
    from lodestone.operators import patterns

    first = patterns.wildcard(rows, "red*", "id", limit=5).select(F.lit("wildcard").alias("part"), "id", "title")
    second = hybrid.search(rows, _vectors(spark, d), "blue bolt", limit=5, lexical_only=True).select(F.lit("lexical").alias("part"), "id", "title")
    third = hybrid.search(rows, _vectors(spark, d), "old ring", first_vector(spark, d), limit=5, floor=0.1).select(F.lit("hybrid").alias("part"), "id", "title")
    return first.unionByName(second).unionByName(third)


@query("g11_rule_table", "SELECT * FROM (VALUES " + ", ".join("('{}', '{}')".format(r[1], ", ".join(r[4][:3])) for r in RULES) + ") t(rule, names)")
def g11(spark, d):
    return hybrid.rule_table(rules(spark))


@query("p15_rule_list", "SELECT * FROM (VALUES ('onesen'), ('that the')) t(rule)")
def p15(spark, d):
    every = rules(spark).withColumn("ecosystem", F.when(F.col("place") < 1, "android").otherwise("web"))
    return hybrid.rule_list(every, "Web", "ui").select("rule")


TREE = '[{"type":"paragraph","inlineContent":[{"type":"text","text":"Use "},{"type":"codeVoice","code":"Gear"},{"type":"strong","inlineContent":[{"type":"text","text":" now"}]}]},{"type":"heading","level":9,"text":"More"},{"type":"unorderedList","items":[{"content":[{"type":"paragraph","inlineContent":[{"type":"text","text":"one"}]}]}]},{"type":"aside","style":"tip","content":[{"type":"paragraph","inlineContent":[{"type":"link","title":"T","destination":"u"}]}]},{"type":"codeListing","code":["a","b"]}]'


@query("c05_markdown", "SELECT 'Use `Gear`** now**' || chr(10) || chr(10) || '###### More' || chr(10) || chr(10) || '- one' || chr(10) || chr(10) || '> [!TIP]' || chr(10) || '> [T](u)' || chr(10) || chr(10) || '```swift' || chr(10) || 'a' || chr(10) || 'b' || chr(10) || '```' AS md, NULL::VARCHAR AS bad")
def c05(spark, d):
    return spark.createDataFrame([(TREE, "[")], "raw string, broken string").select(markup.render(F.col("raw"), "blocks").alias("md"), markup.render(F.col("broken"), "blocks").alias("bad"))


@query("c07_platforms", "SELECT * FROM (VALUES (0, 'iOS 13.0, macOS 10.15 (Beta)'), (1, 'All platforms')) t(i, shown)")
def c07(spark, d):
    rows = spark.createDataFrame([(0, [("iOS", "13.0", None), ("macOS", "10.15", True)]), (1, [])], "i int, p array<struct<name:string,introducedAt:string,beta:boolean>>")
    return rows.select("i", markup.platforms(F.col("p")).alias("shown"))


@query("c03_redact_json", "SELECT * FROM (VALUES (0, '{\"token\":\"[REDACTED]\",\"list\":[1,\"k\"],\"n\":{\"a\":{\"b\":{\"c\":{\"d\":\"[MaxDepthExceeded]\"}}}}}'), (1, 'password=[REDACTED]'), (2, NULL)) t(i, shown)")
def c03_json(spark, d):
    rows = spark.createDataFrame([(0, '{"token": "abc", "list": [1, "k"], "n": {"a": {"b": {"c": {"d": {"e": 1}}}}}}'), (1, "password=hunter2"), (2, None)], "i int, raw string")
    return rows.select("i", logs.redact_json(F.col("raw")).alias("shown"))


@query("c16_levels", "SELECT event_id, CASE event_type WHEN 'error' THEN 4 WHEN 'click' THEN 3 ELSE 2 END AS level FROM events")
def c16(spark, d):
    name = F.when(F.col("event_type") == "click", " WARN ").otherwise(F.col("event_type"))
    return table(spark, d, "events").select("event_id", logs.level_number(name).alias("level"))


def _log_rows(spark, d):
    return table(spark, d, "events").select("ts", "event_id", F.col("event_type").alias("level"), F.concat(F.lit("token="), "event_id", F.lit(" "), "props").alias("message"))


@query("g08_log_fanout", "SELECT event_id, 'token=[REDACTED] ' || props AS message FROM events WHERE event_type = 'error'")
def g08(spark, d):
    return jobs.redacted(_log_rows(spark, d), "warn").select("event_id", "message")


@query("w06_ring_buffer_global", "SELECT event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 100")
def w06_global(spark, d):
    return jobs.ring_buffer(_log_rows(spark, d), "ts", key="event_id").select("event_id")


@query("c18_json_lines", "SELECT event_id, length('{\"ts\":\"' || strftime(ts, '%Y-%m-%dT%H:%M:%S') || '\",\"level\":\"' || event_type || '\",\"message\":\"m\",\"fields\":{\"k\":1}}') AS n FROM events")
def c18(spark, d):
    line = logs.json_line(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.col("event_type"), F.lit("m"), F.struct(F.lit(1).alias("k")))
    return table(spark, d, "events").select("event_id", F.length(line).cast("long").alias("n"))


@query("w08_sessions", """WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events),
  s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM g) SELECT user_id, min(ts) AS began, count(*) AS n FROM s GROUP BY user_id, session""")
def w08(spark, d):
    return jobs.session_counts(table(spark, d, "events")).select("user_id", F.col("session.start").alias("began"), "n")


