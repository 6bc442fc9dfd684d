"""Counts, distributions, freshness and the health report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import kinds as K
from lodestone.functions.text import age_days


def count_by(rows: DataFrame, column: str, where: Column | None = None) -> DataFrame:
    return (rows if where is None else rows.where(where)).groupBy(column).agg(F.count("*").alias("n"))


def distribution(rows: DataFrame, column: Column, top: int = 12) -> DataFrame:
    """(value, n, place): the `top` largest groups, and one row `other` with the rest if there is any."""
    counts = rows.groupBy(column.alias("value")).agg(F.count("*").alias("n"))
    order = [F.col("n").desc(), F.col("value")]
    best = counts.orderBy(*order).limit(top).withColumn("place", F.row_number().over(Window.orderBy(*order)))  # at most `top` rows
    every, kept = counts.agg(F.sum("n").alias("all"), F.count("*").alias("groups")), best.agg(F.sum("n").alias("kept"))  # one row each
    other = every.crossJoin(kept).where(F.col("groups") > top).select(F.lit("other").alias("value"), (F.col("all") - F.col("kept")).alias("n"), F.lit(top + 1).alias("place"))
    return best.unionByName(other)


def unknown_share(rows: DataFrame, kind: str = "kind") -> DataFrame:
    n = F.count_if(K.is_unknown(F.col(kind)))
    return rows.agg(F.count("*").alias("total"), n.alias("unknown"), F.round(F.when(F.count("*") > 0, 100.0 * n / F.count("*")).otherwise(0.0), 2).alias("percent"))


def indexed_split(counts: DataFrame, threshold: int = 25) -> DataFrame:
    return counts.withColumn("state", F.when(F.col("n") >= threshold, "indexed").otherwise("cross-reference"))


def zero_filled(names: DataFrame, counts: DataFrame, key: str, values: Sequence[str]) -> DataFrame:
    """Every name with its counts, matched without case; 0 where there are none."""
    keyed = counts.select(F.lower(key).alias("__key"), *values)
    joined = names.join(keyed, F.lower(names[key]) == F.col("__key"), "left")
    return joined.select(*names.columns, *(F.coalesce(v, F.lit(0)).alias(v) for v in values))


def discover(names: DataFrame, counts: DataFrame, key: str, needle: str = "", drop_empty_at: int = 20, threshold: int = 25, abstract: str | None = None) -> DataFrame:
    """Names with counts, filtered by a substring of the name (or of a column `abstract` of names), empty ones dropped once `drop_empty_at` names have rows; largest first."""
    filled = zero_filled(names, counts, key, ["n"])
    with_rows = filled.agg(F.count_if(F.col("n") > 0).alias("__filled"))
    kept = filled.crossJoin(F.broadcast(with_rows)).where((F.col("n") > 0) | (F.col("__filled") < drop_empty_at)).drop("__filled")
    if needle:
        shown = F.concat_ws("\n", key, abstract) if abstract else F.col(key)
        kept = kept.where(F.contains(F.lower(shown), F.lit(needle.lower())))
    return kept.withColumn("cross_reference", F.col("n") < threshold).orderBy(F.col("n").desc(), key)


def freshness(stamped: Column, now: Column, stale_after: int = 30) -> tuple[Column, Column]:
    """(age in days, state): a stamp in the future is 0 days old; no stamp is unknown."""
    age = F.when(stamped.isNotNull(), age_days(stamped, now))
    return age, F.when(age.isNull(), "unknown").when(age > stale_after, "stale").otherwise("fresh")


def check_row(frame: DataFrame, name: str, value: Column, ok: Column, warn: Column | None = None, hint: str = "") -> DataFrame:
    """A one-row check (name, status, value, hint) from an aggregate over a frame."""
    status = F.when(ok, "ok").when(F.lit(False) if warn is None else warn, "warn").otherwise("fail")
    made = frame.agg(value.cast("double").alias("value"), status.alias("status"))
    return made.select(F.lit(name).alias("check_name"), "status", "value", F.when(F.col("status") == "ok", "").otherwise(hint).alias("hint"))


def doctor(symbols: DataFrame, vectors: DataFrame, indexed: DataFrame | None = None, least_vectors: int = 100, dims: int = 64) -> DataFrame:
    """Union of one-row checks over a catalogue and its vectors."""
    n = F.count("*")
    unknown = F.count_if(K.is_unknown(F.col("kind")))
    widths = F.countDistinct(F.size("embedding"))
    checks = [
        check_row(symbols, "rows", n, n > 0, hint="ingest pages"),
        check_row(symbols, "frameworks", F.countDistinct("framework"), F.countDistinct("framework") > 0, hint="ingest pages"),
        check_row(symbols, "duplicate-ids", n - F.countDistinct("id"), n == F.countDistinct("id"), hint="upsert by id"),
        check_row(symbols, "unknown-kinds", 100.0 * unknown / n, unknown * 100 <= n * 5, unknown * 100 <= n * 20, "repair kinds"),
        check_row(symbols, "empty-abstracts", 100.0 * F.count_if(F.coalesce("abstract", F.lit("")) == "") / n, F.count_if(F.coalesce("abstract", F.lit("")) == "") * 2 <= n, F.lit(True), "enrich abstracts"),
        check_row(symbols, "paths", F.count_if(~F.col("path").startswith("/documentation/")), F.count_if(~F.col("path").startswith("/documentation/")) == 0, F.lit(True), "repair paths"),
        check_row(vectors, "vectors", n, n >= least_vectors, n > 0, "embed more rows"),
        check_row(vectors, "vector-widths", widths, widths <= 1, hint="embed again with one model"),
        check_row(vectors, "expected-width", F.count_if(F.size("embedding") != dims), F.count_if(F.size("embedding") != dims) == 0, F.lit(True), "drop vectors of other widths"),
    ]
    if indexed is not None:
        drift = F.abs(F.sum("base") - F.sum("indexed"))
        checks.append(check_row(indexed, "index-drift", drift, drift == 0, hint="rebuild the index"))
    out = checks[0]
    for more in checks[1:]:
        out = out.unionByName(more)
    return out


def stamp_check(built_at: DataFrame, now: Column, stale_after: int = 30) -> DataFrame:
    """The freshness check from a frame with the newest stamp in `ts`: warns when it is stale or missing."""
    age, state = freshness(F.max("ts"), now, stale_after)
    made = built_at.agg(age.cast("double").alias("value"), F.when(state == "fresh", "ok").otherwise("warn").alias("status"))
    return made.select(F.lit("freshness").alias("check_name"), "status", "value", F.when(F.col("status") == "ok", "").otherwise("build again").alias("hint"))


def index_info(symbols: DataFrame, vectors: DataFrame) -> DataFrame:
    """One row of what version reports show."""
    info = symbols.agg(F.count("*").alias("n"), F.countDistinct("framework").alias("frameworks"), F.countDistinct(F.lower("kind")).alias("kinds"), F.count_if("is_primary").alias("primaries"))
    return info.crossJoin(vectors.agg(F.count("*").alias("vectors")))  # one row each


def summary(report: DataFrame) -> DataFrame:
    return report.groupBy("status").agg(F.count("*").alias("n"))
