"""Names found by stored variants against the scan of all pairs."""

import random

import pytest

from lodestone.functions.text import osa_distance
from lodestone.operators import fuzzy, resolve
from lodestone.plans.bindings import symbols


def typo(rng, name, edits):
    letters = list(name)
    for _ in range(edits):
        at = rng.randrange(len(letters) + 1)
        kind = rng.choice("insert delete replace swap".split())
        if kind == "insert" or len(letters) < 2:
            letters.insert(at, rng.choice("abcde"))
        elif kind == "delete":
            letters.pop(at - 1)
        elif kind == "replace":
            letters[at - 1] = rng.choice("abcde")
        else:
            at = min(at, len(letters) - 2)
            letters[at], letters[at + 1] = letters[at + 1], letters[at]
    return "".join(letters)


def test_no_pair_within_reach_is_lost():
    rng = random.Random(11)
    for _ in range(4000):
        name = "".join(rng.choice("abcde") for _ in range(rng.choice([0, 1, 3, 5, 8, 9, 15, 22, 24, 25, 26, 27, 28, 30, 41])))
        query = typo(rng, name, rng.randint(0, 3))
        if osa_distance(name, query) <= fuzzy.far(len(query)):
            assert fuzzy.stored_keys(name) & fuzzy.asked_keys(query), (name, query)


@pytest.fixture(scope="module")
def index(spark, sf_dir, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("names"))
    fuzzy.build_variants(symbols(spark, sf_dir), "title", f"{path}/v")
    return f"{path}/v"


def test_every_title_with_a_typo(spark, sf_dir, index):
    rng = random.Random(12)
    titles = sorted({r["title"] for r in symbols(spark, sf_dir).select("title").distinct().collect()})
    queries = sorted({typo(rng, t, 1) for t in titles} | {t.upper() for t in titles[:5]} | {"", "zzz"})
    got = {tuple(r) for r in fuzzy.close_names(spark.createDataFrame([(q,) for q in queries] + [(None,)], "q string"), "q", index).collect()}
    want = {(q, t, osa_distance(t.lower(), q.lower())) for q in queries for t in titles}
    assert got == {x for x in want if x[2] <= fuzzy.far(len(x[0]))}


def test_suggestions_by_variants_equal_the_scan(spark, sf_dir, tmp_path):
    rows, index = symbols(spark, sf_dir), f"{tmp_path}/v"
    resolve.name_index(rows, index)
    for query in ("smal rign", "red gaer", "Brand/blue blt", "nothing like it"):
        scan = [(r["title"], r["distance"]) for r in resolve.suggestions(rows, query).collect()]
        fast = [(r["title"], r["distance"]) for r in resolve.suggestions(rows, query, index=index).collect()]
        assert fast == scan
