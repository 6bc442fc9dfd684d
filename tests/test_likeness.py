"""Names joined by pairs of letters against the matcher on every pair."""

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from lodestone.operators import likeness, resolve
from lodestone.plans.bindings import symbols

from .test_fuzzy import typo


def ratio(name, query):
    return SequenceMatcher(None, name, query, autojunk=False).ratio()


@pytest.mark.parametrize("least", [0.1, 0.5, 0.65, 0.9, 1.0])
def test_no_pair_of_the_ratio_is_lost(least):
    rng = random.Random(21)
    for _ in range(3000):
        name = "".join(rng.choice("abcdeé Z") for _ in range(rng.choice([0, 1, 2, 3, 4, 7, 12, 22, 23, 24, 30, 47, 48, 49, 60])))
        other = typo(rng, name, rng.randint(0, 6)) if rng.random() < 0.7 else "".join(rng.choice("abcdeé Z") for _ in range(rng.randint(0, 70)))
        if ratio(name, other) >= least:
            assert set(likeness.keys(name, least)) & set(likeness.keys(other, least)), (name, other)


def test_every_title_with_a_typo(spark, sf_dir):
    rng = random.Random(22)
    titles = sorted({r["title"] for r in symbols(spark, sf_dir).select("title").distinct().collect()} | {"", "a", "ab", "é" * 60})
    queries = sorted({typo(rng, t, 2) for t in titles} | {"", "b", "ba", "é" * 50, "nothing like it"})
    make = lambda names, c: spark.createDataFrame([(x,) for x in [*names, None, names[-1]]], f"{c} string")
    got = {(r["query"], r["name"]): r["ratio"] for r in likeness.like_names(make(queries, "query"), make(titles, "name")).collect()}
    want = {(q, t): ratio(t, q) for q in queries for t in titles if ratio(t, q) >= 0.65}
    assert got == pytest.approx(want) and got.keys() == want.keys()
    best = {(r["query"], r["place"]): r["name"] for r in likeness.closest(make(queries, "query"), make(titles, "name"), 3).collect()}
    assert best == {(q, i + 1): t for q in queries for i, (_, t) in enumerate(sorted((-r, t) for (p, t), r in want.items() if p == q)[:3])}


def test_close_titles_take_primary_rows_and_the_smallest_id(spark):
    rows = spark.createDataFrame([(3, "red gear", True), (2, "red gear", True), (1, "red gears", False), (4, None, True)], "id int, title string, is_primary boolean")
    found = resolve.close_titles(rows, spark.createDataFrame([("red gaer",), (None,)], "query string")).collect()
    assert [(r["title"], r["id"], r["place"]) for r in found] == [("red gear", 2, 1)]
    assert resolve.close_titles(rows.limit(0), spark.createDataFrame([("x",)], "query string")).count() == 0


def test_no_nested_loop(spark, sf_dir):
    names = symbols(spark, sf_dir).select(F.col("title").alias("name"))
    plan = likeness.like_names(names.select(F.col("name").alias("query")), names)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_a_threshold_of_nothing_is_refused(spark):
    names = spark.createDataFrame([("a", "a")], "query string, name string")
    with pytest.raises(ValueError):
        likeness.like_names(names, names, 0.0)
