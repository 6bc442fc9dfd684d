"""The search facade: expansion, lexical search with injection and boosts, gates, vector search, fusion, post-filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators import filters, fulltext, fusion, resolve, vectorsearch

#: Column weights of the search for all tokens and of the search for any.
WEIGHTS = {"title": 10.0, "framework": 2.0, "kind": 1.0, "abstract": 0.5}
ANY_WEIGHTS = {"title": 10.0, "framework": 2.5, "kind": 1.0, "abstract": 2.0}
#: Similarity floors of providers, (semantic preferred, otherwise).
FLOORS = {"hosted": (0.62, 0.65), "local": (0.62, 0.68), "default": (0.55, 0.65)}
LEAST_VECTORS = 100


def floor_of(provider: str | None, prefer_semantic: bool) -> float:
    """The least similarity that counts, by provider."""
    return FLOORS.get((provider or "").strip().lower(), FLOORS["default"])[0 if prefer_semantic else 1]


def clamp_limit(limit, default: int = 20, most: int = 100) -> int:
    try:
        return max(1, min(most, int(limit)))
    except (TypeError, ValueError):
        return default


def models_agree(a: str | None, b: str | None) -> bool:
    """Equal names without case and a leading models/; an unknown model agrees with any."""
    plain = lambda x: (x or "").strip().lower().removeprefix("models/")
    unknown = {"", "unknown", "none"}
    return plain(a) in unknown or plain(b) in unknown or plain(a) == plain(b)


def lexical(rows: DataFrame, query: str, limit: int, mapped: Sequence[str] = (), framework: str | None = None, index: str | None = None) -> DataFrame:
    """(rows, score) of the best `limit`: full text (by scan or from a stored index) or wildcard, exact titles first, up to five mapped names searched as well at 0.9 of their score, and boosts."""
    where = filters.framework_is(F.col("framework"), framework) if framework else None
    kept = rows if where is None else rows.where(where)
    if any(c in query for c in "*?"):
        from lodestone.operators import patterns

        return patterns.wildcard(kept, query, "id", limit=limit).select(*rows.columns, "score")

    def full_text(q: str) -> DataFrame:
        return fulltext.search(rows, WEIGHTS, q, where=where) if index is None else fulltext.find(rows, "id", index, WEIGHTS, q, where)

    found = full_text(query).orderBy(F.col("score").desc(), "id").limit(limit)
    if " " not in query.strip():
        found = fulltext.with_exact_titles(found, kept, F.col("title"), "is_primary", "id", query).drop("stage")
    for token in list(mapped)[:5]:
        more = full_text(token).orderBy(F.col("score").desc(), "id").limit(max(3, limit // 2))
        found = found.unionByName(more.withColumn("score", F.col("score") * 0.9).join(found.select("id"), "id", "left_anti").select(*found.columns))
    return fulltext.boosted(found, F.col("title"), query, mapped)


def mode_of(vectors: DataFrame, query_vector: Sequence[float] | None, stored_model: str | None, query_model: str | None, lexical_only: bool = False) -> str:
    """Why a search stays lexical, or `hybrid`.  The count stops at LEAST_VECTORS rows."""
    if lexical_only:
        return "lexical-only"
    if vectors.limit(LEAST_VECTORS).count() < LEAST_VECTORS:
        return "too-few-vectors"
    if query_vector is None:
        return "no-query-vector"
    return "hybrid" if models_agree(stored_model, query_model) else "model-mismatch"


def search(rows: DataFrame, vectors: DataFrame, query: str, query_vector: Sequence[float] | None = None, limit: int = 20, mapped: Sequence[str] = (), framework: str | None = None,
           platform: str | None = None, kind: str | None = None, prefer_semantic: bool = False, lexical_only: bool = False, floor: float | None = None, stored_model: str | None = None, query_model: str | None = None, index: str | None = None, provider: str | None = None) -> DataFrame:
    """(id, title, framework, kind, path, score, rrf, source), best first.  Rows that only vectors found get their platforms from the symbol table before the platform filter."""
    limit = clamp_limit(limit)
    found = lexical(rows, query, 4 * limit, mapped, framework, index).select("id", "score")
    order = [F.col("score").desc(), F.col("id")]
    if mode_of(vectors, query_vector, stored_model, query_model, lexical_only) == "hybrid":
        low = floor_of(provider, prefer_semantic) if floor is None else floor
        where = filters.framework_is(F.col("framework"), framework) if framework else None
        near = vectorsearch.nearest(vectors, query_vector, "id", 2 * limit, where=where, floor=low).select(vectorsearch.plain_id(F.col("id").cast("string")).cast(rows.schema["id"].dataType).alias("id"), (F.col("sim") * 50).alias("score"))
        a, b = (0.7, 1.8) if prefer_semantic else (1.0, 1.0)
        fused = fusion.fuse(fusion.ranked(found, order), fusion.ranked(near, order), "id", a, b)
    else:
        fused = found.withColumn("rrf", F.lit(None).cast("double")).withColumn("source", F.lit("fts"))
    best = [F.col("rrf").desc_nulls_last(), F.col("score").desc(), F.col("id")]
    out = fused.orderBy(*best).limit(2 * limit).join(rows.select("id", "title", "framework", "kind", "path", "platforms"), "id")
    if platform:
        out = out.where(filters.platform_soft(F.col("platforms"), platform))
    if kind:
        out = filters.kind_soft(out, kind).drop("filter_dropped", "unknown_dropped")
    return out.orderBy(*best).limit(limit).select("id", "title", "framework", "kind", "path", "score", "rrf", "source")


def lookup(rows: DataFrame, pages: DataFrame, query: str, framework: str | None = None) -> DataFrame:
    """The resolved row with its page (path, content) if there is one; `origin` tells whether the page or the row answers."""
    one = resolve.resolve(rows, query, framework).where("resolved")
    page = pages.select(F.lower("path").alias("page_path"), "content")
    return one.join(page, F.lower("path") == F.col("page_path"), "left").withColumn("origin", F.when(F.col("content").isNotNull(), "page").otherwise("catalogue")).drop("page_path")


def reference(rows: DataFrame, pages: DataFrame, vectors: DataFrame, target: str, query_vector: Sequence[float] | None = None) -> DataFrame:
    """(id, title, step): the first that answers of framework/name, plain lookup, and search."""
    clean = target.strip().strip("'\"`")
    head, slash, tail = clean.partition("/")
    steps = []
    if slash and head and not clean.lower().startswith("documentation/"):
        steps.append(lookup(rows, pages, tail, head).select("id", "title", F.lit(0).alias("step")))
    steps.append(lookup(rows, pages, clean).select("id", "title", F.lit(1).alias("step")))
    steps.append(search(rows, vectors, clean, query_vector, limit=5).select("id", "title", F.lit(2).alias("step")))
    every = steps[0]
    for more in steps[1:]:
        every = every.unionByName(more)
    return every.withColumn("first", F.min("step").over(Window.partitionBy())).where("step = first").drop("first")  # at most a handful of rows


def mapped_names(query: str, rules: DataFrame, intents: DataFrame | None = None) -> list[str]:
    """Names that the rules a query meets map it to, then the tokens of its intents: what `search` takes as `mapped`.  One query and a small rule table, so few names."""
    one = rules.sparkSession.createDataFrame([(0, query)], "qid int, query string")
    rows = fusion.mapped_symbols(fusion.expand(one, rules, True)).select("mapped").collect()
    names = [n for r in rows for n in r["mapped"]]
    if intents is not None:
        names += [t for r in fusion.intents(one, intents).orderBy("intent").collect() for t in r["tokens"]]
    return list(dict.fromkeys(names))


def expanded_search(rows: DataFrame, vectors: DataFrame, query: str, rules: DataFrame, intents: DataFrame | None = None, **options) -> DataFrame:
    """`search` with the names of the rules and intents that the query meets."""
    return search(rows, vectors, query, mapped=mapped_names(query, rules, intents), **options)


def ranked_tokens(rows: DataFrame, query: str, rules: DataFrame, intents: DataFrame | None = None, index: str | None = None, limit: int = 10) -> DataFrame:
    """(id, title, rrf, lists): up to six expansion tokens give a list of eight each (weight 1.35 for the first three, else 1), the query itself one of 2 * limit (1.5 where the title
    is the query, else 1), and the lists are fused."""
    lists = []

    def listed(found: DataFrame, most: int, weight) -> None:
        order = [F.col("rank_by"), F.col("id")]
        cut = found.orderBy("tier", "rank", "id").limit(most).withColumn("rank_by", F.struct("tier", "rank"))
        lists.append(fusion.ranked(cut, order).select("id", "rank", weight.alias("weight")))

    def raw(q: str) -> DataFrame:
        args = (F.col("title"), "is_primary")
        return fulltext.search_any(rows, ANY_WEIGHTS, q, *args) if index is None else fulltext.find_any(rows, "id", index, ANY_WEIGHTS, q, *args)

    for i, token in enumerate(mapped_names(query, rules, intents)[:6]):
        listed(raw(token), 8, F.lit(1.35 if i < 3 else 1.0))
    listed(raw(query), 2 * limit, F.when(F.col("tier") == 0, 1.5).otherwise(1.0))
    every = lists[0]
    for more in lists[1:]:
        every = every.unionByName(more)
    fused = fusion.fuse_lists(every, "id").join(rows.select("id", "title", "is_primary"), "id")
    return fused.orderBy(F.col("rrf").desc(), F.col("is_primary").desc(), "id").limit(limit).select("id", "title", "rrf", "lists")


def rule_list(rules: DataFrame, ecosystem: str | None = None, needle: str = "") -> DataFrame:
    """Rules of an ecosystem whose joined text holds the needle."""
    text = F.lower(F.concat_ws(" ", "rule", F.array_join("symbols", " "), F.array_join("terms", " "), F.array_join("frameworks", " ")))
    kept = rules if not ecosystem else rules.where(F.lower("ecosystem") == ecosystem.lower())
    return kept.where(F.contains(text, F.lit(needle.lower()))) if needle else kept


def rule_table(rules: DataFrame, most: int = 12, names: int = 3) -> DataFrame:
    return rules.orderBy("place").limit(most).select("rule", F.array_join(F.slice("symbols", 1, names), ", ").alias("names"))
