"""Names much like a query, for many queries at once: the share of letters in common blocks, without a matcher for each pair.

The ratio of two names is twice the letters in their common blocks over the letters of both: the longest common block is taken, then the longest ones
before and behind it.  Letters in common blocks are common letters, so a ratio of `least` asks for t = least * (letters of both) / 2 common letters,
each counted as often as both names have it.  Written as elements (letter, its how-manieth), in one fixed order, two names with t common
elements share two of the first n - t + 2 elements of each (n its letters).  So names are joined by pairs of such elements; names of which a partner may
need one common letter only, and names with a partner beyond 48 letters, whose pairs would be many, by single elements of the first n - t + 1.
What meets is held against t by the common elements themselves, and only what passes gets the exact ratio.  Common pairs of letters bound the ratio
from above too, but for ratios below 2/3 that bound excludes nothing, so they are not used.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from difflib import SequenceMatcher
from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

LONG = 48
COMMON_LAST = "zqxjkvbpygfwmucldrhsnioate"  # a fixed order that puts rare letters first; any order is right


def needed(letters: int, least: float) -> int:
    """Common letters two names need that have so many letters together."""
    return max(1, math.ceil(least * letters / 2 - 1e-9))


def shortest_partner(n: int, least: float) -> int:
    return math.ceil(n * least / (2 - least) - 1e-9)


def elements(name: str) -> list[str]:
    """The letters with their numbers, those with high numbers and rare letters first."""
    seen: dict[str, int] = {}
    found = []
    for letter in name:
        seen[letter] = seen.get(letter, 0) + 1
        found.append((-seen[letter], COMMON_LAST.find(letter), letter))
    return [f"{letter}{-number}" for number, _, letter in sorted(found)]


def keys(name: str, least: float) -> list[str]:
    """What a name is joined by: names with a ratio of `least` share a key."""
    n = len(name)
    if not n:
        return [""]
    ordered, shortest = elements(name), shortest_partner(n, least)
    t = needed(n + shortest, least)
    found = []
    if n <= LONG:
        found += [f"p{a} {b}" for a, b in combinations(ordered[: n - max(t, 2) + 2], 2)]
        if t == 1:
            found += [f"s{a}" for a in ordered]
    if n > shortest_partner(LONG + 1, least) - 1:
        found += [f"l{a}" for a in ordered[: n - t + 1]]
    return found


def _keyed(names: DataFrame, name: str, least: float) -> DataFrame:
    """(name, its elements, a key) for each key of each name."""
    schema = names.select(name, F.array(F.lit("")).alias(f"{name}_has"), F.lit("").alias("key")).schema

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), 64):
                part = frame.iloc[at : at + 64].copy()
                part[f"{name}_has"] = [elements(x) for x in part[name]]
                part["key"] = [keys(x, least) for x in part[name]]
                yield part.explode("key")

    return names.select(name).mapInPandas(run, schema)


@F.pandas_udf(DoubleType())
def block_ratio(one: pd.Series, other: pd.Series) -> pd.Series:
    """Twice the letters in common blocks over the letters of both; blocks are sought in the first name's order."""
    return pd.Series([SequenceMatcher(None, a, b, autojunk=False).ratio() for a, b in zip(one, other)], dtype="float64")


def possible(query: Column, name: Column, common: Column, least: float) -> Column:
    """Whether so many common elements allow the ratio."""
    return common * 2 >= F.lit(least) * (F.length(query) + F.length(name)) - 1e-9


def like_names(queries: DataFrame, names: DataFrame, least: float = 0.65) -> DataFrame:
    """(query, name, ratio) for the distinct values of the column `query` of one table and `name` of the other whose ratio is at least `least` (above 0), letter case counted.

    Nulls are no names.  Two empty names have the ratio 1.
    """
    if not 0 < least <= 1:
        raise ValueError("least is above 0 and at most 1")
    asked = _keyed(queries.where("query IS NOT NULL").select("query").distinct(), "query", least)
    stored = _keyed(names.where("name IS NOT NULL").select("name").distinct(), "name", least)
    lengths = F.lit(least) * (F.length("query") + F.length("name")) <= 2 * F.least(F.length("query"), F.length("name")) + 1e-9
    met = asked.join(stored, "key").where(lengths).where(possible(F.col("query"), F.col("name"), F.size(F.array_intersect("query_has", "name_has")), least))
    return met.select("query", "name").distinct().withColumn("ratio", block_ratio("name", "query")).where(F.col("ratio") >= least - 1e-12)


def closest(queries: DataFrame, names: DataFrame, most: int = 4, least: float = 0.65) -> DataFrame:
    """(query, name, ratio, place): the best names of each query, ties by name."""
    best = Window.partitionBy("query").orderBy(F.col("ratio").desc(), "name")
    return like_names(queries, names, least).withColumn("place", F.row_number().over(best)).where(F.col("place") <= most)
