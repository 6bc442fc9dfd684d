"""Name resolution in stages, fuzzy suggestions, and framework names from paths."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import glob_pattern, osa
from lodestone.operators import fuzzy, likeness

_MOST_NAMES = 8192

STAGES = ("exact", "nocase", "framework-path", "title", "suffix", "signature")


def _like(column: Column, before: str, name: str, after: str) -> Column:
    literal = glob_pattern(name).replace("*", "%")
    return column.ilike(before + literal + after)


def stage_of(query: str, framework: str | None = None, path: str = "path", title: str = "title", key: str = "id") -> Column:
    """The number of the first stage a row satisfies, or null."""
    raw = query.strip()
    clean = raw.removeprefix("/")
    forms = [raw, clean, f"/{clean}", f"documentation/{clean}"]
    p, t, k = F.col(path), F.col(title), F.col(key).cast("string")
    within = F.lit(True) if not framework else F.lower("framework") == framework.lower()
    exact = p.isin(raw, clean) | k.isin(f"/{clean}", f"documentation/{clean}")
    lowered = [x.lower() for x in forms]
    nocase = F.lower(p).isin(lowered[0], lowered[1]) | F.lower(k).isin(lowered[2], lowered[3])
    head, slash, tail = clean.partition("/")
    by_path = F.lit(False)
    if slash and head and not clean.lower().startswith("documentation/"):
        by_path = (F.lower(p) == f"/documentation/{head.lower()}/{tail.lower()}") & (F.lower("framework") == (framework or head).lower())
    at = clean if clean.startswith("/") else f"/{clean}"
    signature = F.lit(False)
    for test in (_like(p, "%/", clean, "(%"), _like(p, "%/", clean, "-%"), _like(p, "", at, "(%"), _like(p, "", at, "-%"), _like(t, "func ", clean, "(%"), _like(t, "func ", clean, "<%"), _like(t, "var ", clean, ":%"), _like(t, "let ", clean, ":%"), _like(t, "", clean, "(%")):
        signature = signature | test
    tests = (exact & within, nocase & within, by_path, (F.lower(t) == raw.lower()) & within, _like(p, "%/", clean, "") & within, signature & within)
    out = F.lit(None).cast("int")
    for number, test in reversed(list(enumerate(tests))):
        out = F.when(test, number).otherwise(out)
    return out


def resolve(rows: DataFrame, query: str, framework: str | None = None, key: str = "id", most: int = 10) -> DataFrame:
    """Rows of the first stage that has any: one for the first three stages, up to `most` after; `resolved` is true if it is one."""
    tagged = rows.withColumn("stage_no", stage_of(query, framework, key=key)).where("stage_no IS NOT NULL")
    # The best rows of all stages are few once cut, so the window runs over at most `most` rows a stage.
    order = [F.col("stage_no"), F.col("is_primary").desc(), F.length("path"), F.col(key)]
    cut = tagged.orderBy(*order).limit(most)
    first = F.min("stage_no").over(_all())
    kept = cut.withColumn("first", first).where("stage_no = first").withColumn("n", F.row_number().over(_all().orderBy(*order)))
    kept = kept.where((F.col("stage_no") > 2) | (F.col("n") == 1)).withColumn("resolved", F.count("*").over(_all()) == 1)
    return kept.withColumn("stage", F.element_at(F.array(*map(F.lit, STAGES)), F.col("stage_no") + 1)).drop("stage_no", "first", "n")


def _all():
    from pyspark.sql import Window

    return Window.partitionBy()


def max_distance(name: str) -> int:
    return fuzzy.far(len(name))


def _slug() -> Column:
    return F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\(.*\)$", "")


def name_index(rows: DataFrame, path: str) -> None:
    """Stores the deletion variants of all titles and last path segments."""
    fuzzy.build_variants(rows.select(F.explode(F.array("title", _slug())).alias("name")), "name", path)


def suggestions(rows: DataFrame, query: str, framework: str | None = None, most: int = 3, index: str | None = None) -> DataFrame:
    """Titles within the edit distance the name's length allows, nearest first.  levenshtein <= 2 * distance is a sound filter before the exact distance is computed.

    With `index`, a folder written by name_index, the exact distance is only taken of rows whose title or slug is among the close names.
    """
    import re

    name = re.sub(r"\(.*\)$", "", [x for x in query.strip().split("/") if x][-1] if "/" in query else query.strip())
    far = max_distance(name)
    kept = rows if not framework else rows.where(F.lower("framework") == framework.lower())
    kept = kept.where((F.abs(F.length("title") - len(name)) <= far) | F.col("is_primary") | F.contains(F.lower("path"), F.lit(f"/{name.lower()}")))
    slug = _slug()
    if index:
        near = fuzzy.close_names(rows.sparkSession.createDataFrame([(name,)], "name string"), "name", index).select("name")
        names = [r["name"] for r in near.limit(_MOST_NAMES + 1).collect()]
        if len(names) <= _MOST_NAMES:  # more are left to the scan
            kept = kept.where(F.col("title").isin(names) | slug.isin(names))
    could = lambda c: F.levenshtein(F.lower(c), F.lit(name.lower()), 2 * far) >= 0
    kept = kept.withColumn("slug", slug).where(could(F.col("title")) | could(F.col("slug"))).dropDuplicates(["framework", "path"])
    near = kept.withColumn("distance", F.least(osa(F.col("title"), F.lit(name)), F.when(F.col("slug") != "", osa(F.col("slug"), F.lit(name))).otherwise(999)))
    return near.where(F.col("distance") <= far).orderBy("distance", F.col("is_primary").desc(), F.length("title"), "title", "framework", "path").limit(most)


def framework_slug(path: Column) -> Column:
    """The first segment behind /documentation/, in lower case; null where there is none."""
    value = F.trim(path)
    at = F.locate("/documentation/", F.lower(value)) if isinstance(value, str) else F.position(F.lit("/documentation/"), F.lower(value))
    rest = F.when(at > 0, F.substring(value, at + 15, F.length(value))).when(F.lower(value).startswith("documentation/"), F.substring(value, F.lit(15), F.length(value))).otherwise(F.regexp_replace(value, "^/+", ""))
    slug = F.lower(F.trim(F.element_at(F.split(rest, "/"), 1)))
    return F.when(slug != "", slug)


def canonical_framework(slugs: DataFrame, names: DataFrame, slug: str = "slug") -> DataFrame:
    """slugs with `canonical` from names (slug, canonical), null where the slug is unknown: names are never invented."""
    return slugs.join(names, slug, "left")


def candidate_paths(framework: Column, path: Column) -> Column:
    """Ordered, distinct paths under which a page may lie."""
    own = F.regexp_replace(F.trim(path), "^/+", "")
    inside = F.lower(own).startswith("documentation/")
    base = lambda f, p: F.concat(F.lit("documentation/"), f, F.lit("/"), p)
    more = F.array(base(framework, own), base(F.lower(framework), F.lower(own)), base(F.lower(framework), own))
    plain = F.array(own, F.lower(own))
    return F.when(own == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.concat(F.when(inside, F.array().cast("array<string>")).otherwise(more), plain)))


def close_titles(rows: DataFrame, queries: DataFrame, most: int = 4, least: float = 0.65) -> DataFrame:
    """(query, title, id, ratio, place) for the column `query` of queries: the primary titles most like each, with the smallest id of a title."""
    titles = rows.where("is_primary").groupBy(F.col("title").alias("name")).agg(F.min("id").alias("id"))
    return likeness.closest(queries, titles, most, least).join(titles, "name").withColumnRenamed("name", "title")


def disambiguate(rows: DataFrame, query: str, framework: str | None = None, suggest: Callable[[str], DataFrame] | None = None) -> DataFrame:
    """(id, title, framework, path, status, source): the row a path or title means, or up to six candidates, or suggestions.

    A path answers by itself.  Of the rows whose title or last path segment is the name, one answers if it is the only one, if all (or the framework asked for) are of one framework (primary rows
    first), or if it is the only primary one; else they are candidates.  Suggestions come from `suggest` (a search, up to five), and where that has none from close titles.
    """
    raw = query.strip()
    within = rows if not framework else rows.where(F.lower("framework") == framework.strip().lower())
    shown = ["id", "title", "framework", "path"]
    told = lambda df, status, source: df.select(*shown, F.lit(status).alias("status"), (F.lit(source) if isinstance(source, str) else source).alias("source"))
    if not raw:
        return told(rows.limit(0), "empty", "")
    at = raw[raw.find("/documentation/") :] if raw.startswith("doc://") and "/documentation/" in raw else raw
    at = f"/{at}" if at.lower().startswith("documentation/") else at
    if "/" in at:
        whole = at.rstrip("/") if at.startswith("/") else "/documentation/" + at.strip("/")
        found = within.where(F.lower("path") == whole.lower()).orderBy(F.col("is_primary").desc(), "id").limit(1)
        if not found.isEmpty():
            return told(found, "resolved", "exact-path" if at.startswith("/") else "relative-path")
    title = raw.lstrip("@").lower()
    name = re.sub(r"[^A-Za-z0-9_]", "", title.split("(", 1)[0])
    t, leaf = F.lower("title"), F.lower(F.element_at(F.split(F.element_at(F.split("path", "/"), -1), r"\("), 1))
    same = t.isin(title, raw.lower())
    if len(name) >= 2:
        like = same | t.startswith(f"{name}(") | t.startswith(f"func {name}(") | t.startswith(f"static func {name}(") | t.startswith(f"var {name}:") | (leaf == name)
        order = [(~same).cast("int"), F.col("is_primary").desc(), F.length("path"), F.col("id")]
        hits = within.where(like)
        facts = hits.agg(F.count("*").alias("n"), F.countDistinct("framework").alias("frameworks"), F.count_if("is_primary").alias("primaries")).first()  # three numbers
        if facts["n"]:
            if facts["n"] == 1 or framework or facts["frameworks"] == 1:
                first = [F.col("is_primary").desc(), *order]
                return told(hits.orderBy(*first).limit(1), "resolved", "title")
            if facts["primaries"] == 1:
                return told(hits.where("is_primary"), "resolved", "primary-title")
            one = hits.groupBy("framework", "path").agg(F.min_by(F.struct("id", "title", "is_primary"), F.struct((~F.col("is_primary")).cast("int"), "id")).alias("r")).select("framework", "path", "r.*")
            return told(one.orderBy(*order).limit(6), "ambiguous", "candidate")
    if suggest is not None:
        found = suggest(raw.lstrip("@")).limit(5)
        if not found.isEmpty():
            return told(found, "not_found", "search")
    return told(close_titles(within, rows.sparkSession.createDataFrame([(raw.lstrip("@"),)], "query string")).select("id").join(rows, "id"), "not_found", "fuzzy")
