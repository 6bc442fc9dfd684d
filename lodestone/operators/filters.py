"""Row filters: framework, platform and kind, in their soft and hard forms, and candidate selections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import kinds as K
from lodestone.sources.catalog import ensure_checkpoint_dir


def framework_is(column: Column, name: str) -> Column:
    return F.lower(column) == name.lower()


def platform_soft(platforms: Column, name: str) -> Column:
    """No platforms at all passes."""
    return (F.size(F.coalesce(platforms, F.array())) == 0) | platform_hard(platforms, name)


def platform_hard(platforms: Column, name: str) -> Column:
    return F.coalesce(F.exists(platforms, lambda p: F.contains(F.lower(p), F.lit(name.lower()))), F.lit(False))


def kind_soft(rows: DataFrame, wanted: str, kind: str = "kind") -> DataFrame:
    """Rows of the wanted kinds, or all rows if none is; `filter_dropped` tells which, `unknown_dropped` how many unclassified rows fell out."""
    targets = ["unknown" if t in K.UNKNOWN_KINDS else t for t in K.SOFT_KINDS.get(wanted.lower().strip(), (wanted.lower().strip(),))]
    shown = K.display(F.col(kind))
    totals = rows.agg(F.count_if(shown.isin(*targets)).alias("__hits"), F.count_if(shown == "unknown").alias("__unknown"))
    joined = rows.crossJoin(F.broadcast(totals))  # one row
    kept = joined.where((F.col("__hits") == 0) | shown.isin(*targets))
    dropped = F.when((F.col("__hits") > 0) & F.lit("unknown" not in targets), F.col("__unknown")).otherwise(0)
    return kept.withColumn("filter_dropped", F.col("__hits") == 0).withColumn("unknown_dropped", dropped.cast("long")).drop("__hits", "__unknown")


def kind_hard(column: Column, wanted: str) -> Column:
    return F.lower(column).isin(*K.HARD_KINDS.get(wanted.lower(), (wanted.lower(),)))


def embedding_candidates(rows: DataFrame, key: str, kinds: tuple[str, ...] = K.PRIMARY_KINDS) -> DataFrame:
    """Primary rows, type kinds and documented rows, in the order in which they should be embedded."""
    documented = F.coalesce(F.col("abstract"), F.lit("")) != ""
    chosen = rows.where(F.col("is_primary") | F.lower("kind").isin(*[k.lower() for k in kinds]) | documented)
    return numbered(chosen.withColumn("__documented", documented), [F.col("is_primary").desc(), F.col("__documented").desc(), F.col("title"), F.col(key)], "place").drop("__documented")


def all_for_embedding(rows: DataFrame, key: str) -> DataFrame:
    """Every row in the order primary first, then by title."""
    return numbered(rows, [F.col("is_primary").desc(), F.col("title"), F.col(key)], "place")


def numbered(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """rows with their number from 1 in a total order.  Ranges are sorted apart, and each counts on from the rows of the ranges before it."""
    ensure_checkpoint_dir(rows.sparkSession)
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()).checkpoint()
    part = F.shiftright("__at", 33)
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy(part.alias("__part")).agg(F.count("*").alias("__n")).withColumn("__start", F.coalesce(F.sum("__n").over(before), F.lit(0)))  # a row a range
    joined = placed.withColumn("__part", part).join(starts.drop("__n"), "__part")
    return joined.withColumn(name, F.col("__start") + F.col("__at").bitwiseAND((1 << 33) - 1) + 1).drop("__part", "__start", "__at")


def needs_enrichment(rows: DataFrame, frameworks: list[str], kinds: list[str]) -> DataFrame:
    return rows.where(F.col("framework").isin(*frameworks) & F.lower("kind").isin(*[k.lower() for k in kinds]) & (F.coalesce(F.col("abstract"), F.lit("")) == ""))


def page(rows: DataFrame, order: list[Column], number: int, size: int, clamp: bool = True) -> DataFrame:
    """Rows of a page; a number behind the last page gives the last when clamped.  `total` and `page` come along.  A page near the start is a top-k, not a sort of everything."""
    total = rows.count()
    at = max(1, min(number, -(-total // size)) if clamp else number)
    return rows.orderBy(*order).offset((at - 1) * size).limit(size).withColumn("page", F.lit(at).cast("int")).withColumn("total", F.lit(total).cast("long"))


def keep_first(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in an order."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def last_per(rows: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The newest n rows of each key: a ring buffer as a query."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("place") <= n)
