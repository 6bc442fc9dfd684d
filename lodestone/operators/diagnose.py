"""Symbols named in build logs, and where they lead."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Messages that name a symbol, in the order in which they are tried.
PATTERNS = (
    r"'([A-Za-z_][A-Za-z0-9_.:()]*)'\s+was deprecated",
    r"'([A-Za-z_][A-Za-z0-9_.:()]*)'\s+is unavailable",
    r"has no member\s+'([A-Za-z_][A-Za-z0-9_]*)'",
    r"[Cc]annot find (?:type )?'([A-Za-z_][A-Za-z0-9_]*)' in scope",
    r"[Nn]o exact matches in call to (?:instance |static |initializer )?(?:method )?'([A-Za-z_][A-Za-z0-9_]*)'",
)
TAIL_CHARS = 16384


def extract_symbols(log: Column) -> Column:
    """Names in order of pattern and place, cut at ( and behind the first dot, of two letters or more, each once."""
    found = F.concat(*(F.regexp_extract_all(log, F.lit(p), F.lit(1)) for p in PATTERNS))
    plain = F.transform(found, lambda s: F.element_at(F.split(s, r"\("), 1))
    member = F.transform(plain, lambda s: F.when(F.contains(s, F.lit(".")), F.element_at(F.split(s, r"\.", 2), 2)).otherwise(s))
    return F.array_distinct(F.filter(member, lambda s: F.length(s) >= 2))


def hook_gate(events: DataFrame, command_pattern: str, marker: str) -> DataFrame:
    """Failed commands of the kind asked for whose output bears no annotation yet; only the end of the output is kept."""
    kept = events.where((F.col("returncode") != 0) & F.col("command").rlike(command_pattern) & ~F.contains("output", F.lit(marker)))
    return kept.withColumn("output", F.when(F.length("output") > TAIL_CHARS, F.substring("output", -TAIL_CHARS, TAIL_CHARS)).otherwise(F.col("output")))


def ground(logs: DataFrame, symbols: DataFrame, migrations: DataFrame, most: int = 5) -> DataFrame:
    """(log_id, place, name, match, target): a migration entry, else the row whose title is the name, else the shortest title that begins with it.

    Names of a log are at most `most`.  Titles meet names by the prefixes of the lengths that names have, so both lookups are equi-joins on whole strings.
    """
    names = logs.select("log_id", F.posexplode(F.slice(extract_symbols(F.col("log")), 1, most)).alias("place", "name"))
    best = symbols.select(F.lower("title").alias("t"), "title", "is_primary", F.col("id").alias("sid"))
    exact = best.groupBy("t").agg(F.min_by(F.struct("title", "sid"), F.struct((~F.col("is_primary")).cast("int"), "sid")).alias("e"))
    wanted = names.select(F.lower("name").alias("prefix")).distinct()
    lengths = wanted.agg(F.collect_set(F.length("prefix")).alias("lengths"))  # one row of as many numbers as names have lengths
    starts = best.crossJoin(F.broadcast(lengths)).select("*", F.explode(F.filter("lengths", lambda n: n <= F.length("t"))).alias("n")).withColumn("prefix", F.expr("left(t, n)"))
    like = starts.join(wanted, "prefix", "left_semi").groupBy("prefix").agg(F.min_by(F.struct("title", "sid"), F.struct((~F.col("is_primary")).cast("int"), F.length("title"), "t", "sid")).alias("s"))
    names = names.withColumn("prefix", F.lower("name"))
    joined = names.join(migrations, names["name"] == migrations["old"], "left").join(exact, F.lower(names["name"]) == exact["t"], "left").join(like, "prefix", "left")
    match = F.when(F.col("replacement").isNotNull(), "migration").when(F.col("e").isNotNull(), "exact").when(F.col("s").isNotNull(), "suggestion").otherwise("none")
    return joined.select("log_id", "place", "name", match.alias("match"), F.coalesce("replacement", "e.title", "s.title").alias("target"))


def quoted_migrations(logs: DataFrame, migrations: DataFrame) -> DataFrame:
    """(log_id, name, replacement) of every quoted name in a log that a migration entry knows, each once."""
    names = logs.select("log_id", F.explode(F.array_distinct(F.regexp_extract_all("log", F.lit("'([A-Za-z_][A-Za-z0-9_]*)'"), F.lit(1)))).alias("name"))
    return names.join(migrations.select(F.col("old").alias("name"), "replacement"), "name").select("log_id", "name", "replacement")
