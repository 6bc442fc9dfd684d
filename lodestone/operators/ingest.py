"""Ingestion: conflict-aware upsert, page and tree explosion, media, repair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import kinds as K
from lodestone.operators.resolve import framework_slug
from lodestone.sources.catalog import ensure_checkpoint_dir


def upsert(rows: DataFrame, key: str | list[str], order: list[str], keep_if_empty: tuple[str, ...] = ("abstract",), arrays: tuple[str, ...] = ("platforms",), kind: str = "kind", primary: str = "is_primary", without: tuple[str, ...] = ()) -> DataFrame:
    """Folds rows of one key in arrival order, as repeated upserts would: the last value wins, but an empty text or array keeps the one before,
    and an unknown kind keeps the last known kind with its primary flag.  Columns named in `without` are not returned.  One partial aggregation; no group is collected.

    An aggregate holds its place in the order, so columns that follow the same rule share one.
    """
    keys = [key] if isinstance(key, str) else key
    at = F.struct(*order)
    columns = [c for c in rows.columns if c not in keys and c not in without]
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    folds = []
    if columns:
        folds.append(F.max_by(F.struct(*(text(c).alias(c) if c in keep_if_empty else F.col(c) for c in columns)), at).alias("__last"))
    known = [c for c in columns if c in (kind, primary) and c not in keep_if_empty and c not in arrays]
    if known:
        folds.append(F.max_by(F.struct(*known), F.when(~K.is_unknown(F.col(kind)), at)).alias("__known"))
    full = {c: text(c) != "" for c in columns if c in keep_if_empty} | {c: F.size(F.coalesce(F.col(c), F.array())) > 0 for c in columns if c in arrays and c not in keep_if_empty}
    folds += [F.max_by(F.col(c), F.when(some, at)).alias(f"__full_{c}") for c, some in full.items()]
    if not folds:
        return rows.select(*keys).distinct()
    before = {c: F.col(f"__full_{c}") for c in full} | {c: F.col("__known").getField(c) for c in known}
    value = lambda c: F.coalesce(before[c], F.col("__last").getField(c)) if c in before else F.col("__last").getField(c)
    return rows.groupBy(*keys).agg(*folds).select(*(c if c in keys else value(c).alias(c) for c in rows.columns if c not in without or c in keys))


def replace_by_id(old: DataFrame, new: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """Insert or replace: rows of `new` win, of several with one key the last in order (any, without one)."""
    new = new.dropDuplicates([key]) if order is None else new.groupBy(key).agg(F.max_by(F.struct(*new.columns), F.col(order)).alias("r")).select("r.*")
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def cleared(vectors: DataFrame, meta: DataFrame, keys: tuple[str, ...] = ("has_embeddings", "semantic_item_count", "embedding_model", "embedding_provider", "embedded_at")) -> tuple[DataFrame, DataFrame]:
    """No vectors, and meta (key, value) without what describes them."""
    return vectors.limit(0), meta.where(~F.col("key").isin(*keys))


def meta_upsert(meta: DataFrame, key: str = "key", value: str = "value", order: str = "at") -> DataFrame:
    """The last value of each key."""
    return meta.groupBy(F.col(key).alias("key")).agg(F.max_by(value, order).alias("value"))


def corrected(rows: DataFrame, corrections: DataFrame, key: str, column: str) -> DataFrame:
    """rows with `column` replaced where corrections (key, column) has a value."""
    fix = corrections.select(F.col(key), F.col(column).alias("__new"))
    return rows.join(fix, key, "left").withColumn(column, F.coalesce("__new", column)).drop("__new")


PAGE_SCHEMA = (
    "metadata struct<title:string,symbolKind:string,roleHeading:string,platforms:array<struct<name:string,introducedAt:string,beta:boolean>>>, identifier struct<url:string>, "
    "abstract array<struct<type:string,text:string>>, references map<string,struct<title:string,kind:string,symbolKind:string,roleHeading:string,url:string,type:string,alt:string,"
    "abstract:array<struct<type:string,text:string>>,platforms:array<struct<name:string>>,variants:array<struct<traits:array<string>,url:string>>>>"
)


def abstract_text(parts: Column) -> Column:
    """Parts joined by a space, white space collapsed."""
    return F.trim(F.regexp_replace(F.array_join(F.transform(F.coalesce(parts, F.array()), lambda p: F.coalesce(p["text"], F.lit(""))), " "), r"\s+", " "))


def page_rows(pages: DataFrame, framework: Column, default_platforms: Column | None = None) -> DataFrame:
    """Symbol rows of parsed pages: the page itself, and each reference of kind symbol or article that has a title."""
    default = F.array().cast("array<string>") if default_platforms is None else default_platforms
    names = lambda p: F.transform(p, lambda x: x["name"])
    own = F.when(F.size(F.coalesce(F.col("metadata.platforms"), F.array())) > 0, names(F.col("metadata.platforms"))).otherwise(default)
    strip = lambda u: F.regexp_replace(u, "^doc://[^/]+", "")
    root = pages.select(framework.alias("framework"), F.col("metadata.title").alias("title"), K.resolve(F.col("metadata.symbolKind"), F.col("metadata.roleHeading"), F.lit(None).cast("string")).alias("kind"), abstract_text(F.col("abstract")).alias("abstract"), strip(F.col("identifier.url")).alias("path"), own.alias("platforms"))
    refs = pages.select(framework.alias("framework"), own.alias("page_platforms"), F.explode("references").alias("ref_id", "r")).where(F.col("r.kind").isin("symbol", "article") & (F.coalesce(F.col("r.title"), F.lit("")) != ""))
    of_ref = F.when(F.size(F.coalesce(F.col("r.platforms"), F.array())) > 0, names(F.col("r.platforms"))).otherwise(F.col("page_platforms"))
    linked = refs.select("framework", F.col("r.title").alias("title"), K.resolve(F.col("r.symbolKind"), F.col("r.roleHeading"), F.col("r.kind")).alias("kind"), abstract_text(F.col("r.abstract")).alias("abstract"), strip(F.coalesce("r.url", "ref_id")).alias("path"), of_ref.alias("platforms"))
    every = root.where("title IS NOT NULL").unionByName(linked)
    return every.withColumn("is_primary", K.is_primary(F.col("kind"))).withColumn("id", F.col("path"))


def topic_references(pages: DataFrame) -> DataFrame:
    """(page, topic, place, ref_id, title) for pages (page, topicSections array<struct<title,identifiers>>, references map): what each topic names, in order; unknown names fall out."""
    each = pages.select("page", "references", F.posexplode("topicSections").alias("n", "s")).select("page", "references", F.col("s.title").alias("topic"), F.posexplode("s.identifiers").alias("place", "ref_id"))
    return each.withColumn("r", F.try_element_at("references", "ref_id")).where("r IS NOT NULL").select("page", "topic", "place", "ref_id", F.col("r.title").alias("title"))


def media_rows(pages: DataFrame, base_url: str) -> DataFrame:
    """(ref_id, alt, url, mime) of image and video references: the 2x light variant, else a light one, else the first."""
    refs = pages.select(F.explode("references").alias("ref_id", "r")).where(F.col("r.type").isin("image", "video") | (F.col("r.kind") == "image"))
    v = F.coalesce(F.col("r.variants"), F.array())
    has = lambda x, t: F.array_contains(F.coalesce(x["traits"], F.array()), t)
    chosen = F.coalesce(F.get(F.filter(v, lambda x: has(x, "light") & has(x, "2x")), 0), F.get(F.filter(v, lambda x: has(x, "light")), 0), F.get(v, 0))
    picked = refs.withColumn("raw", chosen["url"]).where("raw IS NOT NULL AND raw <> ''")
    url = F.when(F.col("raw").startswith("http"), F.col("raw")).otherwise(F.concat(F.lit(base_url), F.when(F.col("raw").startswith("/"), F.lit("")).otherwise(F.lit("/")), F.col("raw")))
    extension = F.lower(F.element_at(F.split(url, r"\."), -1))
    mime = F.when(extension.isin("jpg", "jpeg"), "image/jpeg").when(extension == "svg", "image/svg+xml").when(extension == "mp4", "video/mp4").otherwise("image/png")
    return picked.select("ref_id", F.coalesce("r.alt", "r.title", F.lit("")).alias("alt"), url.alias("url"), mime.alias("mime"))


def walk_tree(spark: SparkSession, nodes: DataFrame) -> DataFrame:
    """Depth-first rows of an edge table (node, parent, ordinal, title, path, type): `place` orders them as a walk would meet them.

    A node that several parents share, or that comes again below itself, is met once, at the first of its places.  Rounds go on until no place gets earlier; a longer walk never comes
    before its own beginning, so cycles end.  Group markers and nodes without title, path or type carry their children but no row; of equal paths the first in the walk stays.
    """
    ensure_checkpoint_dir(spark)
    placed = lambda walk: F.min(F.struct(walk.alias("walk"), "title", "path", "type")).alias("r")
    best = nodes.where("parent IS NULL").groupBy("node").agg(placed(F.array("ordinal"))).select("node", "r.*").checkpoint()
    front = best
    while not front.isEmpty():
        up = front.select(F.col("node").alias("parent"), F.col("walk").alias("above"))
        below = nodes.join(up, "parent").groupBy("node").agg(placed(F.array_append("above", F.col("ordinal")))).select("node", "r.*")
        known = best.select("node", F.col("walk").alias("had"))
        front = below.join(known, "node", "left").where("had IS NULL OR walk < had").drop("had").checkpoint()
        best = best.unionByName(front).groupBy("node").agg(placed(F.col("walk"))).select("node", "r.*").checkpoint()
    every = best
    listed = every.where("title IS NOT NULL AND title <> '' AND path IS NOT NULL AND path <> '' AND type IS NOT NULL AND type <> '' AND type <> 'groupMarker'")
    first = listed.withColumn("path", F.regexp_replace("path", "^doc://[^/]+", "")).groupBy(F.lower("path").alias("path_key")).agg(F.min_by(F.struct("node", "title", "path", "type", "walk"), F.col("walk")).alias("r"))
    return first.select("r.*").withColumn("kind", K.resolve(F.col("type"), F.lit(None).cast("string"), F.lit(None).cast("string"))).withColumnRenamed("walk", "place")


def repairs(rows: DataFrame, names: DataFrame, key: str) -> DataFrame:
    """(key, framework, canonical) where the path names another known framework than the row."""
    slugged = rows.where(F.col("path").startswith("/documentation/")).select(key, "framework", framework_slug(F.col("path")).alias("slug"))
    return slugged.join(names, "slug").where(F.lower("framework") != F.lower("canonical")).select(key, "framework", "canonical")


def kind_repairs(rows: DataFrame, pages: DataFrame, key: str) -> DataFrame:
    """(key, kind, found) for unclassified rows whose page (path, symbolKind, roleHeading) tells a kind: what a repair would write, so reading it is the dry run."""
    of_page = pages.select(F.lower("path").alias("page_path"), K.resolve(F.col("symbolKind"), F.col("roleHeading"), F.lit(None).cast("string")).alias("found")).where(~K.is_unknown(F.col("found")))
    unknown = rows.where(K.is_unknown(F.col("kind"))).select(key, "kind", F.lower("path").alias("page_path"))
    return unknown.join(of_page.groupBy("page_path").agg(F.min("found").alias("found")), "page_path").select(key, "kind", "found")


def enriched(rows: DataFrame, pages: DataFrame) -> DataFrame:
    """Empty abstracts filled from pages (path, text)."""
    fill = pages.select(F.lower("path").alias("__path"), F.col("text").alias("__text")).dropDuplicates(["__path"])
    joined = rows.join(fill, F.lower("path") == F.col("__path"), "left")
    return joined.withColumn("abstract", F.when(F.coalesce("abstract", F.lit("")) == "", F.coalesce("__text", F.lit(""))).otherwise(F.col("abstract"))).drop("__path", "__text")
