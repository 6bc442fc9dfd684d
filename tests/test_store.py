import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.functions import logs, markup, text
from lodestone.operators import diagnose, hybrid, resolve
from lodestone.sources import catalog, embedder, store


def test_store_paths():
    assert store.store_path({"LODESTONE_STORE": "a/b"}, "/r") == "/r/a/b"
    assert store.store_path({"LODESTONE_STORE": "s3a://x/y"}, "/r") == "s3a://x/y"
    assert store.store_path({}, "/r", writable=lambda p: True) == "/r/data/store"
    assert store.store_path({"HOME": "/h"}, "/r", writable=lambda p: False) == "/h/.cache/lodestone/store"


def test_seed_guard_and_canary(spark, tmp_path):
    source, target = f"{tmp_path}/a", f"{tmp_path}/b"
    rows = spark.createDataFrame([(1,)], "id int")
    for name in ("symbols", "vectors"):
        rows.write.parquet(f"{source}/{name}")
    spark.createDataFrame([("built_at", "x")], "key string, value string").write.parquet(f"{source}/meta")
    assert store.seed(spark, source, target) and not store.seed(spark, source, target)
    opened = store.snapshot(spark, f"{target}/symbols")
    store.guard(spark, f"{target}/symbols", opened)
    rows.write.mode("overwrite").parquet(f"{target}/symbols")
    with pytest.raises(store.ReplacedError):
        store.guard(spark, f"{target}/symbols", opened)
    assert store.readable(spark, f"{target}/symbols") and not store.readable(spark, f"{target}/none")
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "x.parquet").write_bytes(b"no parquet")
    assert not store.readable(spark, f"{tmp_path}/bad")
    assert store.hydrate_once(rows.limit(0), lambda: rows).count() == 1


def test_ttl_cache():
    now = [0.0]
    cache = store.TtlCache(2, 10, lambda: now[0])
    assert cache.get("a", lambda: 1) == 1 and cache.get("a", lambda: 2) == 1
    cache.get("b", lambda: 2)
    cache.get("a")
    cache.get("c", lambda: 3)
    assert cache.get("b") is None and cache.get("a") == 1
    now[0] = 11
    assert cache.get("a") is None


PAGE = {
    "metadata": {"title": "Gear", "symbolKind": "class", "platforms": [{"name": "iOS", "introducedAt": "13.0", "beta": True}]}, "identifier": {"url": "doc://x/documentation/core/gear"}, "abstract": [{"type": "text", "text": "Round."}],
    "primaryContentSections": [
        {"kind": "declarations", "declarations": [{"tokens": [{"text": "class "}, {"text": "Gear"}], "languages": ["swift"]}]}, {"kind": "parameters", "parameters": [{"name": "x", "content": []}]},
        {"kind": "content", "content": [{"type": "paragraph", "inlineContent": [{"type": "text", "text": "Long talk."}]}]},
    ],
    "topicSections": [{"title": "Parts", "identifiers": ["r1", "none", *"abcdef"]}], "references": {"r1": {"title": "Ring", "kind": "symbol", "roleHeading": "Protocol", "url": "/documentation/core/ring", "abstract": [{"text": "R" * 120}]}},
}


def test_pages_as_markdown():
    whole, short = markup.page(PAGE), markup.page(PAGE, True)
    want = ["# Gear", "**Type:** class\n**Platforms:** iOS 13.0 (Beta)", "## Declaration\n```swift\nclass Gear\n```", "### Parameters\n- `x`", "## Overview\nRound."]
    assert short == "\n\n".join(want)
    assert whole == "\n\n".join([*want, "## Discussion\nLong talk.", f"## Topics\n### Parts\n• **Ring** - {'R' * 97}...\n*... and 3 more items*"])
    assert markup.short_blocks([{"type": "heading", "level": 1, "text": "x"}, *[{"type": "paragraph", "inlineContent": [{"type": "text", "text": "p"}]}] * 9]).count("p") == 5


def test_results_as_markdown():
    rows = [{"title": "Gear", "framework": "Core", "kind": "class", "path": "/p", "platforms": ["iOS"], "abstract": "Round."}, {"title": "Guide", "kind": "article", "path": "/g"}]
    shown = markup.results("gear", rows, {"Query Mode": "keyword"})
    assert shown.index("## Symbols") < shown.index("### Gear (Core)") < shown.index("## Articles & Guides") < shown.index("### Guide")
    assert "**Matches Found:** 2" in shown and "   • **Platforms:** All platforms" in shown


def test_archives_become_a_store(spark, tmp_path):
    catalog.ensure_checkpoint_dir(spark)
    folder = tmp_path / "in" / "Core.doccarchive" / "data" / "documentation"
    folder.mkdir(parents=True)
    (folder / "gear.json").write_text(json.dumps(PAGE))
    (folder / "bad.json").write_text("{")
    root, to = str(tmp_path / "in"), str(tmp_path / "out")
    assert [tuple(r) for r in catalog.ingest_archives(spark, root, to, "now", dry_run=True).collect()] == [("Core", 2, 1)]
    assert not (tmp_path / "out").exists()
    catalog.ingest_archives(spark, root, to, "now")
    assert catalog.open_catalog(spark, to)["vectors"].count() == 0
    one = spark.createDataFrame([("a", "Core", "Gear", "class", "s", "/p", None, None, [0.5, 1.0])], catalog.VECTOR_SCHEMA)
    one.write.mode("overwrite").parquet(f"{to}/vectors")
    catalog.ingest_archives(spark, root, to, "now")
    assert catalog.open_catalog(spark, to)["vectors"].collect() == one.collect()  # a later ingest leaves them alone
    stored = catalog.open_catalog(spark, to)["symbols"]
    assert {(r["title"], r["kind"], r["is_primary"]) for r in stored.collect()} == {("Gear", "class", True), ("Ring", "protocol", True)}
    assert {r["key"]: r["value"] for r in spark.read.parquet(f"{to}/meta").collect()} == {"built_at": "now", "symbol_count": "2", "frameworks": "Core"}
    found = hybrid.lexical(stored, "round", 5, index=f"{to}/index").collect()
    assert [r["title"] for r in found] == ["Gear"]


def test_lines_and_errors(spark):
    line = logs.text_line(F.lit("t"), F.lit("warn"), F.lit("m"), F.lit("token=abc"), F.struct(F.lit(1).alias("k")), F.lit("oops"))
    assert spark.range(1).select(line.alias("x")).first()["x"] == '[t] [WARN] [m] token=[REDACTED] {"k":1}\noops'
    deep = {"message": "a", "cause": {"msg": "password=b", "code": 3, "cause": "x"}}
    assert logs.serialized_error(deep) == {"name": "Error", "message": "a", "cause": {"name": "Error", "message": "password=[REDACTED]", "code": 3, "cause": {"name": "Error", "message": "x"}}}
    got = spark.createDataFrame([("{}",), (None,), ("not json",)], "x string").select(logs.error_json(F.col("x")).alias("y")).collect()
    assert [json.loads(r["y"])["message"] for r in got] == ["Unknown error", "Unknown error", "not json"]
    nest = value = {}
    for _ in range(9):
        value["cause"] = value = {}
    assert "[MaxDepthExceeded]" in json.dumps(logs.serialized_error(nest))


def test_a_secret_across_the_cut_is_masked():
    assert "ghp_" not in logs.redact_value("x" * 1990 + " ghp_" + "a" * 40)


def test_folding_takes_all_latin_letters(spark):
    row = spark.createDataFrame([("Vi\u1ec7t \u01a1 \u01ce e\u0301tude",)], "a string").select(text.tokens(F.col("a")).alias("t")).first()
    assert row["t"] == ["viet", "o", "a", "etude"] == text.query_tokens("Vi\u1ec7t \u01a1 \u01ce e\u0301tude")


def test_edit_distances_together():
    rng = np.random.default_rng(1)
    names = ["".join(rng.choice(list("abc"), rng.integers(0, 9))) for _ in range(300)]
    got = text.osa_distances(names, names[::-1])
    assert got.tolist() == [text.osa_distance(a, b) for a, b in zip(names, names[::-1], strict=True)]


def test_edit_distance_query(spark, sf_dir):
    from lodestone.plans import registry

    for r in registry.QUERIES["r04_edit_distance"](spark, sf_dir).collect():
        d = text.osa_distance(r["title"].lower(), "blue grae")
        assert r["distance"] == d and r["ratio"] == pytest.approx(1 - d / max(len(r["title"]), 9), abs=1e-6)


def test_breaker_and_choice():
    now, calls = [0.0], []

    def failing(texts, dims):
        calls.append(1)
        raise OSError

    call = embedder.with_breaker(failing, 30, lambda: now[0])
    for want in (OSError, embedder.BreakerOpenError):
        with pytest.raises(want):
            call([], 1)
    now[0] = 31
    with pytest.raises(OSError):
        call([], 1)
    assert len(calls) == 2
    assert embedder.choose("local", failing, embedder.hash_provider, 768)[0] == "local" and embedder.choose(None, failing, None, 768)[0] == "hosted" and embedder.choose(None, None, None, 768) is None
    with pytest.raises(ValueError):
        embedder.choose(None, None, None, 7)
    assert hybrid.floor_of("Local", False) == 0.68 and hybrid.floor_of(None, True) == 0.55


def test_small_predicates():
    assert [hybrid.clamp_limit(x) for x in (None, 0, 7.9, 1000, "x")] == [20, 1, 7, 100, 20]
    assert hybrid.models_agree("models/A", "a") and hybrid.models_agree(None, "a") and not hybrid.models_agree("a", "b")


def test_close_titles_and_suggestions(spark):
    rows = spark.createDataFrame([(1, "NavigationStack", "Core", "/documentation/core/navigationstack", True), (2, "Gear", "Core", "/documentation/core/gear", True)], "id int, title string, framework string, path string, is_primary boolean")
    got = resolve.disambiguate(rows, "NavgationStak").collect()
    assert [(r["title"], r["status"], r["source"]) for r in got] == [("NavigationStack", "not_found", "fuzzy")]
    assert resolve.disambiguate(rows, "gear").first()["status"] == "resolved"
    assert resolve.disambiguate(rows, " ").count() == 0
    assert diagnose.quoted_migrations(spark.createDataFrame([(0, "'a' 'a' 'b'")], "log_id int, log string"), spark.createDataFrame([("a", "z")], "old string, replacement string")).count() == 1
