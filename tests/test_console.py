import pytest

from lodestone.operators import console
from lodestone.plans import console_queries


@pytest.mark.parametrize("line, want", [
    (None, ("demo", "")), ("  ", ("demo", "")), ("Demo", ("demo", "")), ("demo now", ("semantic", "demo now")), ("INFO", ("status", "")), ("doc  Gear ", ("doc", "Gear")),
    ("bridge a  b", ("idiom", "a  b")), ("searching", ("semantic", "searching")), ("search", ("search", "")), ("red gear", ("semantic", "red gear")), ("diagnose\terror: x", ("diagnose", "error: x")),
])
def test_parse(line, want):
    assert console.parse(line) == want


@pytest.mark.parametrize("value, want", [(None, None), ("", None), (" ALL ", None), (" Core", "Core"), (7, "7")])
def test_choice(value, want):
    assert console.choice(value) == want


@pytest.fixture(scope="module")
def shop(spark, sf_dir):
    return console_queries.catalogue(spark, sf_dir)


def test_a_page_needs_a_path(shop):
    with pytest.raises(ValueError):
        console.doc(shop, " ")


def test_diagnosis_passes_the_gate(shop):
    text = "error: value has no member 'oldRing'"
    assert [(r["name"], r["match"], r["target"]) for r in console.diagnosed(shop, text, returncode="odd").collect()] == [("oldRing", "migration", "newRing")]
    assert console.diagnosed(shop, text, returncode=0).count() == 0
    assert console.diagnosed(shop, text, "ls").count() == 0
    assert console.diagnosed(shop, text + " [grounded]").count() == 0
    assert console.diagnosed(shop, None).count() == 0


def test_demo_and_empty_commands(shop):
    got = console.dispatch(shop, "", "red*", "red gear", "error: value has no member 'oldRing'").collect()
    stages = [r["stage"] for r in got]
    assert stages.count("status") == 1 and stages.count("wildcard") == console.SHOWN and 0 < stages.count("search") <= console.SHOWN
    assert [r["detail"] for r in got if r["stage"] == "diagnose"] == ["newRing"]
    assert console.dispatch(shop, "search", query="red*").count() == console.SHOWN
    assert console.dispatch(shop, "idiom red").count() <= console.SHOWN_IDIOMS
    assert console.dispatch(shop, "index").count() > 0
