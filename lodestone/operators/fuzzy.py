"""Names within an edit distance, for many queries at once, by stored deletion variants.

If two names are at most d edits apart (insert, delete, replace, swap of neighbours), then deleting at most d letters from each makes them equal
somewhere.  So names are stored under all their variants with up to three letters deleted, queries make theirs, and an equi-join gives
the candidates; only these get the exact distance.  A query's length sets its d, and a variant that lacks more than d letters is not asked for.
Names longer than 24 letters would have too many variants: they are halved.  Of three edits one half gets at most one, so a long name is stored
under the variants, with one letter deleted, of every piece that could be half of a query.  Only a swap across the middle is in both halves;
for it the left half without its last letter is a third piece.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import osa

MOST_LETTERS = 24


def far(length: int) -> int:
    """Edits allowed for a query of so many letters."""
    return 1 if length <= 4 else 2 if length <= 8 else 3


def variants(name: str, d: int) -> set[str]:
    """The name with up to d letters deleted."""
    return {"".join(name[i] for i in range(len(name)) if i not in gone) for n in range(min(d, len(name)) + 1) for gone in combinations(range(len(name)), n)}


def stored_keys(name: str) -> set[str]:
    """Keys a stored name stands under.  A short one: variants for three edits.  A long one: variants for one edit of every piece that could be half of a long query."""
    if len(name) <= MOST_LETTERS + 3:
        keys = {f"s{v}" for v in variants(name, 3)}
    else:
        keys = set()
    if len(name) > MOST_LETTERS - 3:
        for total in range(max(len(name) - 3, MOST_LETTERS + 1), len(name) + 4):  # lengths a query can have
            half = total // 2
            for size in range(half - 2, half + 2):
                keys |= {f"{side}{total}:{v}" for side, left in (("l", half), ("m", half - 1)) if abs(size - left) < 2 for v in variants(name[:size], 1)}
            for size in range(total - half - 1, total - half + 2):
                keys |= {f"r{total}:{v}" for v in variants(name[max(0, len(name) - size) :], 1)}
    return keys


def asked_keys(name: str) -> set[str]:
    d = far(len(name))
    if len(name) <= MOST_LETTERS:
        return {f"s{v}" for v in variants(name, d)}
    half = len(name) // 2
    left = {f"{side}{len(name)}:{v}" for side, size in (("l", half), ("m", half - 1)) for v in variants(name[:size], 1)}
    return left | {f"r{len(name)}:{v}" for v in variants(name[half:], 1)}


def _keyed(names: DataFrame, name: str, keys) -> DataFrame:
    """A row for each key of each name, in column `__key`."""
    schema = names.select(name, F.lit("").alias("__key")).schema

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), 64):  # some thousand keys a name
                part = frame.iloc[at : at + 64].copy()
                part["__key"] = [sorted(keys(x.lower())) for x in part[name]]
                yield part.explode("__key")

    return names.select(name).mapInPandas(run, schema)


def build_variants(names: DataFrame, name: str, path: str) -> None:
    """Under path: (key, name) for the distinct names, clustered by key."""
    distinct = names.where(F.col(name).isNotNull()).select(F.col(name).alias("name")).distinct()
    _keyed(distinct, "name", stored_keys).withColumnRenamed("__key", "key").repartitionByRange("key", "name").sortWithinPartitions("key", "name").write.parquet(path)


def close_names(queries: DataFrame, query: str, path: str) -> DataFrame:
    """(query, name, distance) for the distinct queries and the stored names within the distance each query's length allows, letter case aside."""
    asked = _keyed(queries.where(F.col(query).isNotNull()).select(F.col(query).alias("query")).distinct(), "query", asked_keys)
    stored = queries.sparkSession.read.parquet(path)
    pairs = asked.join(stored, asked["__key"] == stored["key"]).select("query", "name").distinct()
    d = F.when(F.length("query") <= 4, 1).when(F.length("query") <= 8, 2).otherwise(3)
    near = pairs.where(F.abs(F.length("query") - F.length("name")) <= d).withColumn("distance", osa(F.col("name"), F.col("query")))
    return near.where(F.col("distance") <= d)
