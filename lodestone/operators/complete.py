"""Completions of what was typed, from stored prefixes.

A label may be completed from the start of each of its words.  For every prefix of up to six letters the best labels are stored, so that an
answer is a few rows in one pruned row group; longer prefixes read a range of a second table, which holds every label under its starts in order.
Letter case is folded, words are parted by blanks.  The order of labels is total: primary first, then short, then by code point.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LONGEST = 6
ROWS_A_GROUP = 1 << 20  # bytes of a row group: an answer reads one or two


def starts(label: Column) -> Column:
    """The folded label from each of its words on."""
    words = F.filter(F.split(F.lower(label), " "), lambda w: w != "")
    rest = F.transform(F.sequence(F.lit(1), F.size(words)), lambda i: F.array_join(F.slice(words, i, F.size(words)), " "))
    return F.array_distinct(F.when(F.size(words) > 0, rest).otherwise(F.array().cast("array<string>")))


def labels(rows: DataFrame, label: str, key: str, primary: str) -> DataFrame:
    """(label, is_primary, id): distinct labels; one is primary if any of its rows is, and its id is the smallest of the primary ones, else of all."""
    flag = F.coalesce(F.col(primary), F.lit(False))
    per = rows.where(F.col(label).isNotNull()).groupBy(F.col(label).alias("label"))
    return per.agg(F.max(flag).alias("is_primary"), F.coalesce(F.min(F.when(flag, F.col(key))), F.min(key)).alias("id"))


def _order() -> list[Column]:
    return [F.col("is_primary").desc(), F.length("label"), F.col("label")]


def build_completions(rows: DataFrame, label: str, key: str, primary: str, path: str, most: int = 8) -> None:
    """Under path: `prefixes`, the best labels of each short prefix, and `starts`, all labels by their starts.

    Each task keeps its own best rows of a prefix before the shuffle, so a prefix of many labels sends no more than `most` rows a task.
    """
    found = labels(rows, label, key, primary).withColumn("start", F.explode(starts(F.col("label"))))
    letters = F.transform(F.sequence(F.lit(1), F.least(F.length("start"), F.lit(LONGEST))), lambda n: F.substring(F.col("start"), F.lit(1), n))
    short = found.select("label", "is_primary", "id", F.explode(letters).alias("prefix")).distinct()
    best = Window.partitionBy("prefix").orderBy(*_order())
    placed = short.withColumn("place", F.row_number().over(best)).where(F.col("place") <= most)
    write = lambda df, name: df.write.option("parquet.block.size", ROWS_A_GROUP).parquet(f"{path}/{name}")
    write(placed.repartitionByRange("prefix", "place").sortWithinPartitions("prefix", "place"), "prefixes")
    write(found.repartitionByRange("start", "label").sortWithinPartitions("start", "label"), "starts")


def complete(spark: SparkSession, path: str, typed: str, most: int = 8, first: DataFrame | None = None) -> DataFrame:
    """(source, label, id, place): up to three labels of `first` (place, label) that contain what was typed, then stored labels, up to `most` together.  Nothing typed, no stored label.

    What was typed may end with a blank: then a word ends there.
    """
    words = " ".join(w for w in typed.lower().split(" ") if w)
    asked = f"{words} " if words and typed.endswith(" ") else words
    if len(asked) <= LONGEST:
        stored = spark.read.parquet(f"{path}/prefixes").where(F.col("prefix") == asked)
    else:
        stored = spark.read.parquet(f"{path}/starts").where(F.col("start").startswith(asked)).select("label", "is_primary", "id").distinct()
    stored = stored.orderBy(*_order()).limit(most)
    shown = stored.select(F.lit("title").alias("source"), "label", "id", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*_order())).alias("place"))
    if first is None:
        return shown
    hits = first.where(F.contains(F.lower("label"), F.lit(words))).orderBy("place", "label").limit(3)
    none = F.lit(None).cast(shown.schema["id"].dataType)
    ruled = hits.select(F.lit("rule").alias("source"), "label", none.alias("id"), (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("place", "label")) - 3).alias("place"))
    both = ruled.unionByName(shown).orderBy("place").limit(most)
    return both.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("place")))


def stored_prefixes(spark: SparkSession, path: str) -> DataFrame:
    """(prefix, place, label, id): every stored completion."""
    return spark.read.parquet(f"{path}/prefixes").select("prefix", "place", "label", "id")
