"""Wildcard and substring search, with scores and total orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import contains_folded, glob_pattern


def like(text: Column, glob: str) -> Column:
    return F.coalesce(text.ilike(glob_pattern(glob)), F.lit(False))


def wildcard(rows: DataFrame, glob: str, key: str, title: str = "title", abstract: str = "abstract", primary: str = "is_primary", limit: int = 20) -> DataFrame:
    """Title or abstract matches: title matches first, then primary, then short titles; with a score of the same shape."""
    in_title = like(F.col(title), glob)
    found = rows.withColumn("title_match", in_title.cast("int")).where(in_title | like(F.col(abstract), glob))
    score = F.when(F.col("title_match") == 1, 10.0).otherwise(1.0) + F.when(F.col(primary), 5.0).otherwise(0.0) - F.least(F.lit(5.0), F.length(title) * 0.1)
    return found.withColumn("score", score).orderBy(F.col("title_match").desc(), F.col(primary).desc(), F.length(title), title, key).limit(limit)


def wildcard_titles(rows: DataFrame, glob: str, key: str, title: str = "title", primary: str = "is_primary", limit: int = 20) -> DataFrame:
    """Title matches only, at score 1: primary first, then short titles."""
    return rows.where(like(F.col(title), glob)).withColumn("score", F.lit(1.0)).orderBy(F.col(primary).desc(), F.length(title), key).limit(limit)


def substring(rows: DataFrame, needle: str, key: str, columns: tuple[str, ...], limit: int = 20) -> DataFrame:
    found = F.lit(False)
    for c in columns:
        found = found | contains_folded(F.col(c), needle)
    return rows.where(found).withColumn("score", F.lit(1.0)).orderBy(key).limit(limit)


def query_mode(query: Column) -> Column:
    """wildcard, exact-symbol or keyword."""
    return F.when(query.rlike(r"[*?]"), "wildcard").when(query.rlike(r"^[A-Za-z_][A-Za-z0-9_.]*$") | F.lower(query).startswith("documentation/"), "exact-symbol").otherwise("keyword")
