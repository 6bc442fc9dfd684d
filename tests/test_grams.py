"""Wildcards and substrings by trigrams against the scans."""

import pytest

from lodestone.operators import grams, patterns
from lodestone.plans.bindings import symbols


@pytest.fixture(scope="module")
def rows(spark, sf_dir):
    odd = [(-1, "a%b_c", None, True), (-2, None, "Zürich \\ x", False), (-3, "", "", True), (-4, "*star?", "ab", False), (-5, "Q", "é", True)]
    extra = spark.createDataFrame([(i, t, "F", "k", a, "/p", ["x"], p) for i, t, a, p in odd], symbols(spark, sf_dir).schema)
    return symbols(spark, sf_dir).unionByName(extra).cache()


@pytest.fixture(scope="module")
def path(rows, tmp_path_factory):
    where = str(tmp_path_factory.mktemp("grams"))
    grams.build_grams(rows, "id", ["title", "abstract"], where)
    return where


@pytest.mark.parametrize("glob", ["red*", "*ring", "?ld*", "*d r*g", "cold gear", "*", "?", "??", "a%b_c", "q", "*é", "*zü*", "re*of size 1?", "*xyzzy*", "", "*\\*", "r*g"])
def test_globs(rows, path, glob):
    for limit in (20, 100_000):
        assert grams.wildcard(rows, path, glob, "id", limit).collect() == patterns.wildcard(rows, glob, "id", limit=limit).collect()
    assert grams.wildcard_titles(rows, path, glob, "id").collect() == patterns.wildcard_titles(rows, glob, "id").collect()


@pytest.mark.parametrize("needle", ["ring", "R", "d g", "RE", "a%b", "*star?", "\\ x", "zürich", "", "nowhere", "of size 12"])
def test_needles(rows, path, needle):
    assert grams.substring(rows, path, needle, "id", ("title", "abstract"), 100_000).collect() == patterns.substring(rows, needle, "id", ("title", "abstract"), 100_000).collect()


def test_the_filter_reaches_the_scan(rows, path):
    plan = grams.candidates(rows.sparkSession, path, "*gizmo*", ("title",))._jdf.queryExecution().toString()
    assert "In(gram" in plan
