"""Wildcard and substring search from stored trigrams: few candidates by their rarest trigrams, then the exact test on those alone.

A text is lower-cased and given one sign before it and two behind it, so every place begins a trigram.  The literal runs of a glob, with the
signs where the glob is anchored, give trigrams that a match must hold; the rarest of them are met by an aggregate over their postings.  A
glob whose runs are all shorter than three letters looks up the trigrams that begin with its longest run, which are one range of the index.
Only a glob without any letter reads all rows.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import inverted, patterns
from lodestone.sources import store
from lodestone.sources.catalog import bounded_batches

BEGIN, END = "\x01", "\x02"
_RAREST = 4
_MOST_LISTED = 8192


def build_grams(rows: DataFrame, key: str, columns: Sequence[str], path: str) -> None:
    """Under path: postings (gram, col, docs) in order of gram, a row for a gram and batch of texts, and counts (gram, col, n)."""
    spark = rows.sparkSession
    bounded_batches(spark)
    letters = [F.concat(F.lit(BEGIN), F.lower(c), F.lit(END + END)).alias(f"t{i}") for i, c in enumerate(columns)]
    kind = rows.schema[key].dataType.simpleString()
    turned = rows.select(F.col(key).alias("doc"), *letters).mapInArrow(inverted.grams_by_id(columns), f"gram string, col string, docs array<{kind}>")
    turned.withColumn("turn", F.monotonically_increasing_id()).write.parquet(f"{path}/turned")  # so that sampling for the ranges reads grams alone
    sorted_ = spark.read.parquet(f"{path}/turned").repartitionByRange("gram", "turn").sortWithinPartitions("gram", "col", "turn").drop("turn")
    sorted_.write.option("parquet.page.row.count.limit", 64).option("parquet.page.size.row.check.min", 8).parquet(f"{path}/postings")
    store.delete(spark, f"{path}/turned")
    written = spark.read.parquet(f"{path}/postings")
    written.groupBy("gram", "col").agg(F.sum(F.size("docs")).alias("n")).repartitionByRange("gram").sortWithinPartitions("gram").write.parquet(f"{path}/counts")


def needed(glob: str) -> tuple[list[str], str]:
    """Trigrams every match of a glob holds, and, where there are none, a run of one or two letters that begins one (empty: no letter at all)."""
    runs = [r for r in re.split(r"[*?]+", f"{BEGIN}{glob.lower()}{END}{END}") if r.strip(BEGIN + END) or (r and not re.search(r"[*?]", glob))]
    grams = sorted({r[i : i + 3] for r in runs for i in range(len(r) - 2)})
    return grams, "" if grams else max(runs, key=len, default="")


def candidates(spark: SparkSession, path: str, glob: str, columns: Sequence[str]) -> DataFrame | None:
    """(doc) of the rows of which some column may match; None if the glob tells nothing."""
    grams, start = needed(glob)
    postings = spark.read.parquet(f"{path}/postings").where(F.col("col").isin(*columns))
    if start:
        return postings.where(F.col("gram").startswith(start)).select(F.explode("docs").alias("doc")).distinct()
    if not grams:
        return None
    return _holding(spark, path, grams, columns)


def _holding(spark: SparkSession, path: str, grams: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(doc) of the rows of which one column holds the rarest of some trigrams."""
    postings = spark.read.parquet(f"{path}/postings").where(F.col("col").isin(*columns))
    counts = spark.read.parquet(f"{path}/counts").where(F.col("gram").isin(*grams) & F.col("col").isin(*columns))
    n = {g: 0 for g in grams}
    for r in counts.groupBy("gram").agg(F.sum("n").alias("n")).collect():  # a row for each trigram of the glob
        n[r["gram"]] = r["n"]
    rarest = sorted(grams, key=lambda g: (n[g], g))[:_RAREST]
    met = postings.where(F.col("gram").isin(rarest)).select("col", F.explode("docs").alias("doc")).groupBy("doc", "col").agg(F.count("*").alias("n"))
    return met.where(F.col("n") == len(rarest)).select("doc").distinct()


def narrowed(rows: DataFrame, key: str, found: DataFrame | None) -> DataFrame:
    """The rows of some keys: few are named in a filter that reaches the scan, many are joined."""
    if found is None:
        return rows
    listed = [r[0] for r in found.limit(_MOST_LISTED + 1).collect()]
    if len(listed) <= _MOST_LISTED:
        return rows.where(F.col(key).isin(listed)) if listed else rows.limit(0)
    return rows.join(found.select(F.col("doc").alias(key)), key, "left_semi")


def wildcard(rows: DataFrame, path: str, glob: str, key: str, limit: int = 20) -> DataFrame:
    """What patterns.wildcard finds in title and abstract."""
    return patterns.wildcard(narrowed(rows, key, candidates(rows.sparkSession, path, glob, ("title", "abstract"))), glob, key, limit=limit)


def wildcard_titles(rows: DataFrame, path: str, glob: str, key: str, limit: int = 20) -> DataFrame:
    return patterns.wildcard_titles(narrowed(rows, key, candidates(rows.sparkSession, path, glob, ("title",))), glob, key, limit=limit)


def substring(rows: DataFrame, path: str, needle: str, key: str, columns: Sequence[str], limit: int = 20) -> DataFrame:
    """What patterns.substring finds: a needle's own stars are letters, so its runs are taken as they are."""
    literal = needle.lower()
    grams = [literal[i : i + 3] for i in range(len(literal) - 2)]
    spark = rows.sparkSession
    if not literal:
        found = None
    elif grams:
        found = _holding(spark, path, sorted(set(grams)), columns)
    else:
        found = spark.read.parquet(f"{path}/postings").where(F.col("col").isin(*columns) & F.col("gram").startswith(literal)).select(F.explode("docs").alias("doc")).distinct()
    if found is not None:
        # Results come in order of key, so if the candidates of the smallest keys hold `limit` of them, no other row is one.
        listed = [r[0] for r in found.where("doc IS NOT NULL").orderBy("doc").limit(_MOST_LISTED + 1).collect()]
        if len(listed) > _MOST_LISTED:
            first = patterns.substring(rows.where(F.col(key).isin(listed[:_MOST_LISTED])), needle, key, tuple(columns), limit)
            nulls = rows.where(F.col(key).isNull()).limit(1).count()  # they would come first
            if not nulls and first.count() >= limit:
                return first
    return patterns.substring(narrowed(rows, key, found), needle, key, tuple(columns), limit)
