"""Stored completions against the scan of all labels."""

import pytest

from lodestone.operators import complete

ROWS = [
    (1, "Red Gear", False), (2, "red gear", True), (3, "Gear  shift", False), (4, "Gear  shift", True), (5, "gearbox", None), (6, None, True), (7, "", False), (8, " ", False),
    (9, "Ünder gear", False), (10, "gear gear gear", False), (11, "Gearbox of gold", True), (12, "g", False), (13, "x" * 3000 + " gearbox", False),
] + [(100 + i, f"gear part {i:02d}", False) for i in range(20)]


def scan(typed, most=8):
    words = " ".join(w for w in typed.lower().split(" ") if w)
    asked = f"{words} " if words and typed.endswith(" ") else words
    if not asked:
        return []
    found = []
    for label in {t for _, t, _ in ROWS if t is not None}:
        parts = [w for w in label.lower().split(" ") if w]
        if any(" ".join(parts[i:]).startswith(asked) for i in range(len(parts))):
            mine = [(k, bool(p)) for k, t, p in ROWS if t == label]
            primary = any(p for _, p in mine)
            found.append((not primary, len(label), label, min(k for k, p in mine if p == primary or not primary)))
    return [(label, k) for _, _, label, k in sorted(found)[:most]]


@pytest.fixture(scope="module")
def path(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("complete"))
    complete.build_completions(spark.createDataFrame(ROWS, "id int, title string, main boolean"), "title", "id", "main", f"{at}/c")
    return f"{at}/c"


def test_every_prefix_equals_the_scan(spark, path):
    stored = {}
    for r in complete.stored_prefixes(spark, path).orderBy("prefix", "place").collect():
        stored.setdefault(r["prefix"], []).append((r["label"], r["id"]))
    every = {t for _, label, _ in ROWS if label for words in [[w for w in label.lower().split(" ") if w]] for i in range(len(words)) for s in [" ".join(words[i:])] for t in (s[:n] for n in range(1, min(6, len(s)) + 1))}
    assert stored == {p: scan(p) for p in every}


@pytest.mark.parametrize("typed", ["", " ", "g", "GEAR", "gear ", "gear p", "gear  part 1", "gearbox of", "ü", "zzz", "gear' OR 1", "gear%", "gear pa"])
def test_one_answer(spark, path, typed):
    got = complete.complete(spark, path, typed)
    assert [(r["label"], r["id"]) for r in got.orderBy("place").collect()] == scan(typed)


def test_rules_come_first_and_count(spark, path):
    rules = spark.createDataFrame([(0, "gearing"), (2, "Big GEAR"), (1, "cog"), (3, "gear train"), (4, "gear four")], "place int, label string")
    got = [(r["source"], r["label"]) for r in complete.complete(spark, path, "gear", 5, rules).orderBy("place").collect()]
    assert got == [("rule", "gearing"), ("rule", "Big GEAR"), ("rule", "gear train")] + [("title", t) for t, _ in scan("gear", 2)]


def test_the_filter_reaches_the_files_and_tasks_send_few_rows(spark, path):
    for typed, wanted in (("gear", "EqualTo(prefix,gear)"), ("gear part", "StringStartsWith(start,gear part)")):
        assert wanted in complete.complete(spark, path, typed)._jdf.queryExecution().toString()


def test_no_labels(spark, tmp_path):
    complete.build_completions(spark.createDataFrame([], "id int, title string, main boolean"), "title", "id", "main", str(tmp_path / "c"))
    assert complete.complete(spark, str(tmp_path / "c"), "a").count() == 0
    assert complete.complete(spark, str(tmp_path / "c"), "a long one").count() == 0
