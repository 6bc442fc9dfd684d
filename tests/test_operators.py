import pytest
from pyspark.sql import functions as F

from lodestone.operators import diagnose, filters, fulltext, fusion, ingest, patterns, resolve, vectorsearch
from lodestone.operators.fulltext import Phrase
from lodestone.sources import catalog, embedder

SYMBOL = "id long, title string, framework string, kind string, abstract string, path string, is_primary boolean"


def catalogue(spark, titles, primary=()):
    rows = [(i, t, "Core", "struct", "", f"/documentation/core/{t.lower()}", t in primary) for i, t in enumerate(titles)]
    return spark.createDataFrame(rows, SYMBOL)


@pytest.mark.parametrize("glob, want", [("Grid*", {"GridItem", "GridXtem", "GridItemExtra"}), ("*Item", {"GridItem"}), ("Grid?tem", {"GridItem", "GridXtem"}), ("100%*", set())])
def test_wildcards(spark, glob, want):
    rows = catalogue(spark, ["GridItem", "GridXtem", "GridItemExtra", "Itemizer"])
    assert {r["title"] for r in patterns.wildcard(rows, glob, "id").collect()} == want


def test_wildcard_order(spark):
    rows = catalogue(spark, ["SomeVeryLongButtonListStyle", "ButtonStyle", "ListStyle"], {"ButtonStyle", "ListStyle"})
    assert [r["title"] for r in patterns.wildcard(rows, "*Style", "id", limit=2).collect()] == ["ListStyle", "ButtonStyle"]


HOSTILE = ['"', "'", "a AND b", "NEAR(a b)", "*", "(", ")", "[x]", "{x}", "~x", "a:b", "'; DROP TABLE t; --", "%_%", "\\", "^^^"]


@pytest.mark.parametrize("query", HOSTILE)
def test_hostile_queries(spark, query):
    rows = catalogue(spark, ["alpha", "beta"])
    assert fulltext.search(rows, {"title": 1.0}, query).count() <= 2


def test_bm25_formula(spark):
    rows = spark.createDataFrame([(0, "a b"), (1, "a c c"), (2, "d"), (3, "e f"), (4, "g")], "id int, text string")
    got = {r["id"]: r["score"] for r in fulltext.bm25(rows, {"text": 1.0}, [Phrase(("c",))]).collect()}
    import math

    idf = math.log((5 - 1 + 0.5) / (1 + 0.5))
    assert got == {1: pytest.approx(idf * 2 * 2.2 / (2 + 1.2 * (0.25 + 0.75 * 3 / 1.8)))}


def test_phrases_overlap_and_prefix(spark):
    rows = spark.createDataFrame([(0, "a a a"), (1, "red gearbox"), (2, "gearbox red")], "id int, text string")
    n = lambda p: {r["id"]: r["__f0"] for r in fulltext.counted(rows, {"text": 1.0}, [p]).collect()}
    assert n(Phrase(("a", "a"))) == {0: 2.0, 1: 0.0, 2: 0.0}
    assert n(Phrase(("red", "gear"), True)) == {0: 0.0, 1: 1.0, 2: 0.0}
    assert n(Phrase(("red", "gear"))) == {0: 0.0, 1: 0.0, 2: 0.0}


def test_index_agrees_with_scan(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    fulltext.build_index(docs, "doc_id", ["text", "lang"], str(tmp_path))
    weights = {"text": 2.0, "lang": 1.0}
    for match in ("all", "any"):
        scan = fulltext.bm25(docs, weights, [Phrase(("th",), True), Phrase(("en",), True)], match=match)
        index = fulltext.search_index(spark, str(tmp_path), weights, [[Phrase(("th",), True)], [Phrase(("en",), True)]], match).withColumnRenamed("doc", "doc_id")
        a = {r["doc_id"]: round(r["score"], 9) for r in scan.collect()}
        b = {r["doc_id"]: round(r["score"], 9) for r in index.collect()}
        assert a == b and a
    assert not fulltext.index_drift(docs, spark, str(tmp_path)).first()["drift"]
    plan = fulltext.search_index(spark, str(tmp_path), weights, [[Phrase(("th",), True)]])._jdf.queryExecution().toString()
    assert "StringStartsWith(term,th)" in plan
    for query in ("the of", "th zzzqqq", "ofThe", "zzzqqq", "!", "en"):
        scan = {r["doc_id"]: round(r["score"], 9) for r in fulltext.search(docs, weights, query, where=F.col("doc_id") % 2 == 0).collect()}
        assert scan == {r["doc_id"]: round(r["score"], 9) for r in fulltext.find(docs, "doc_id", str(tmp_path), weights, query, F.col("doc_id") % 2 == 0).collect()}


def test_shared_and_deep_nodes_are_met_once(spark):
    deep = [(f"d{i}", f"d{i - 1}" if i else None, 0, f"t{i}", f"/d{i}", "class") for i in range(70)]
    shared = [("r", None, 1, "r", "/r", "class")] + [(f"l{i}{x}", p, j, f"l{i}{x}", f"/l{i}{x}", "class") for i in range(12) for j, x in enumerate("ab") for p in (["r"] if i == 0 else [f"l{i - 1}a", f"l{i - 1}b"])]
    got = ingest.walk_tree(spark, spark.createDataFrame(deep + shared, "node string, parent string, ordinal int, title string, path string, type string")).collect()
    assert len(got) == 70 + 1 + 24
    assert {r["node"]: r["place"] for r in got}["l2b"] == [1, 0, 0, 1]


def test_grounding_takes_names_of_two_letters(spark):
    symbols = spark.createDataFrame([(1, "abcdef", False), (2, "abc", True), (3, "zz", True)], "id int, title string, is_primary boolean")
    logs = spark.createDataFrame([(0, "'ab' was deprecated, 'ZZ' is unavailable")], "log_id int, log string")
    none = spark.createDataFrame([], "old string, replacement string")
    assert {(r["name"], r["match"], r["target"]) for r in diagnose.ground(logs, symbols, none).collect()} == {("ab", "suggestion", "abc"), ("ZZ", "exact", "zz")}


def test_replacing_keeps_one_row_a_key(spark):
    old, new = spark.createDataFrame([(1, "a", 0), (2, "b", 0)], "id int, v string, at int"), spark.createDataFrame([(2, "c", 1), (2, "d", 2), (3, "e", 1)], "id int, v string, at int")
    assert sorted((r["id"], r["v"]) for r in ingest.replace_by_id(old, new, "id", "at").collect()) == [(1, "a"), (2, "d"), (3, "e")]
    assert ingest.replace_by_id(old, new, "id").count() == 3


def test_nearest_rows_against_all_pairs(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    vectors = [(i, rng.integers(-2, 3, 3 if i % 7 else 2).astype(float).tolist() if i % 11 else None) for i in range(90)]
    rows = spark.createDataFrame(vectors, "id int, embedding array<float>")
    queries = rows.where("id % 20 = 0").select(F.col("id").alias("qid"), F.col("embedding").alias("qvec"))
    got = {(r["qid"], r["place"]): (r["id"], round(r["sim"], 9)) for r in vectorsearch.nearest_by_row(rows, queries, "id", 4, block=2).collect()}
    for q, v in vectors:
        if q % 20 == 0 and v:
            unit = lambda x: np.array(x) / (np.linalg.norm(x) or 1)
            best = sorted((-round(float(unit(v) @ unit(w)), 9), i) for i, w in vectors if w and len(w) == len(v) and i != q)[:4]
            assert [got[q, n] for n in range(1, 5)] == [(i, -s) for s, i in best]


def test_soft_kind_filter_falls_back(spark):
    rows = catalogue(spark, ["a", "b"]).withColumn("kind", F.when(F.col("id") == 0, "method").otherwise("symbol"))
    hit = filters.kind_soft(rows, "func").collect()
    assert [(r["id"], r["filter_dropped"], r["unknown_dropped"]) for r in hit] == [(0, False, 1)]
    assert {r["filter_dropped"] for r in filters.kind_soft(rows, "macro").collect()} == {True}


def test_fusion_marks_hybrid(spark):
    a = spark.createDataFrame([(1, 5.0, 0), (2, 4.0, 1)], "id int, score double, rank int")
    b = spark.createDataFrame([(1, 0.9, 0), (3, 0.8, 1)], "id int, score double, rank int")
    got = {r["id"]: r for r in fusion.fuse(a, b, "id").collect()}
    assert (got[1]["source"], got[2]["source"], got[3]["source"]) == ("hybrid", "fts", "semantic")
    assert got[1]["score"] == 5.0 and got[1]["rrf"] == pytest.approx(2 / 61)


def test_expansion_is_case_sensitive_where_asked(spark):
    rules = spark.createDataFrame([(0, "Room", ["Room", "room database"], True, ["Store(x:)", "@Model"], ["Data"])], "place int, rule string, terms array<string>, case_sensitive boolean, symbols array<string>, frameworks array<string>")
    queries = spark.createDataFrame([(0, "chat room layout"), (1, "Room database"), (2, "use room-database now"), (3, "")], "qid int, query string")
    assert {r["qid"] for r in fusion.expand(queries, rules).collect()} == {1, 2}
    assert fusion.mapped_symbols(fusion.expand(queries, rules)).where("qid = 1").first()["mapped"] == ["Store", "Model"]


def test_upsert_folds_in_order(spark):
    rows = [(1, 1, "struct", "old", ["iOS"], True), (1, 2, "unknown", "", [], False), (2, 1, "symbol", None, None, False), (2, 2, "Symbol", "x", None, True), (1, 3, "symbol", None, None, False)]
    df = spark.createDataFrame(rows, "id int, seq int, kind string, abstract string, platforms array<string>, is_primary boolean")
    got = {r["id"]: (r["kind"], r["abstract"], r["platforms"], r["is_primary"]) for r in ingest.upsert(df, "id", ["seq"]).collect()}
    assert got == {1: ("struct", "old", ["iOS"], True), 2: ("Symbol", "x", None, True)}


def test_tree_precedence_cycles_and_markers(spark, tmp_path):
    catalog.ensure_checkpoint_dir(spark)
    edges = [
        ("swift", None, 0, None, None, None), ("occ", None, 1, None, None, None), ("m", "swift", 0, "group", "/g", "groupMarker"), ("a", "m", 0, "A swift", "doc://x/core/a", "class"),
        ("b", "a", 0, "B", "/core/b", "struct"), ("a", "b", 0, "A again", "/core/a", "class"), ("c", "occ", 0, "A occ", "/CORE/A", "class"), ("d", "occ", 1, "", "/core/d", "class"),
    ]
    rows = ingest.walk_tree(spark, spark.createDataFrame(edges, "node string, parent string, ordinal int, title string, path string, type string")).orderBy("place").collect()
    assert [(r["title"], r["path"], r["kind"]) for r in rows] == [("A swift", "/core/a", "class"), ("B", "/core/b", "struct")]


def test_resolver_stages(spark):
    rows = catalogue(spark, ["Stack", "stack", "view-x"])
    rows = rows.unionByName(spark.createDataFrame([(9, "func pad(_:)", "Core", "func", "", "/documentation/core/pad(_:)", False)], SYMBOL))
    stage = lambda q: sorted({r["stage"] for r in resolve.resolve(rows, q).collect()})
    assert stage("/documentation/core/stack") == ["exact"]
    assert stage("/Documentation/Core/Stack") == ["nocase"]
    assert stage("Core/view-x") == ["framework-path"]
    assert stage("STACK") == ["title"]
    assert stage("pad") == ["signature"]
    assert resolve.resolve(rows, "STACK").select("resolved").first()[0] is False


def test_suggestions(spark):
    rows = catalogue(spark, ["NavigationStack", "NavigationView", "Color"])
    assert [r["title"] for r in resolve.suggestions(rows, "Core/NavgationStack()").collect()] == ["NavigationStack"]
    assert resolve.suggestions(rows, "Zzzzz").count() == 0


def test_diagnostics(spark):
    log = "x: 'View.navigationBarTitle(_:)' was deprecated\nvalue has no member 'foo'\nhas no member 'f'"
    got = spark.createDataFrame([(log,)], "log string").select(diagnose.extract_symbols(F.col("log"))).first()[0]
    assert got == ["navigationBarTitle", "foo"]
    events = spark.createDataFrame([(1, "swift build", "err"), (0, "swift build", "err"), (1, "ls", "err"), (1, "swift build", "[seen]")], "returncode int, command string, output string")
    assert diagnose.hook_gate(events, r"\bswift\b", "[seen]").count() == 1


def test_vector_artifact_round_trip(spark, sf_dir, tmp_path):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").limit(40)
    manifest = catalog.export_vectors(vectors, 64, str(tmp_path), "m", "2024-01-01").first()
    assert manifest["totalVectors"] == 40 and manifest["dimensions"] == 64
    own = vectors.limit(3)
    assert catalog.import_vectors(spark, str(tmp_path), own, "vec_id").count() == 40
    bad = spark.read.json(f"{tmp_path}/manifest").withColumn("sha256", F.lit("0"))
    bad.coalesce(1).write.mode("overwrite").json(f"{tmp_path}/other")
    (tmp_path / "manifest").rename(tmp_path / "kept")
    (tmp_path / "other").rename(tmp_path / "manifest")
    with pytest.raises(ValueError, match="manifest"):
        catalog.import_vectors(spark, str(tmp_path), own, "vec_id")


def test_archives(spark, tmp_path):
    page = tmp_path / "X.doccarchive" / "data" / "documentation"
    page.mkdir(parents=True)
    (page / "a.json").write_text('{"metadata": {"title": "A"}}')
    (page / "b.json").write_text("not json")
    found = catalog.read_archives(spark, str(tmp_path), "metadata struct<title:string>").cache()
    assert catalog.archive_counts(found).collect()[0].asDict() == {"archive": "X", "pages": 2, "corrupt": 1}


def test_embedder_checks_width(spark):
    rows = spark.createDataFrame([(1, "a b"), (2, None)], "id long, text string")
    assert [len(r["embedding"]) for r in embedder.embed(rows, "id", "text", 8).collect()] == [8, 8]
    import numpy as np

    calls = []

    def flaky(texts, dims):
        calls.append(1)
        if len(calls) < 2:
            raise OSError("down")
        return np.zeros((len(texts), dims), np.float32)

    assert embedder.with_retries(flaky, wait=0)(["x"], 4).shape == (1, 4)


def test_expansion_by_automaton_equals_the_nested_loop(spark):
    schema = "place int, rule string, terms array<string>, case_sensitive boolean, symbols array<string>, frameworks array<string>"
    rules = [(0, "a", ["nav stack", "Nav: bar", "x/y"], False, ["@N"], []), (1, "b", ["Gear"], True, ["G"], ["F"]), (2, "c", ["gear", "c++", "ΟΔΟΣ"], False, ["g"], []), (3, "d", ["", "été", "in"], False, [], []), (4, "e", ["_x", "Straße", "a.b"], None, [], [])]
    queries = [(1, "Use a NAV-STACK with gear"), (2, "Gears and GEAR"), (3, "Gear"), (4, "c++ or in_x"), (5, "  "), (6, None), (7, "nav: bar x/y"), (8, "ἡ οδος έ ΟΔΟΣ Été"), (9, "straße a.b a_b STRASSE"), (10, "inside"), (11, "win, in"), (11, "gear"), (None, "gear"), (12, "in " * 50_000)]
    queries, rules = spark.createDataFrame(queries, "qid long, query string"), spark.createDataFrame(rules, schema)
    for slash in (False, True):
        shown = ["qid", "rule", "symbols", "frameworks", "place"]
        want = sorted(map(repr, fusion.expand(queries, rules, slash).select(*shown).distinct().collect()))
        assert sorted(map(repr, fusion.expand_all(queries, rules, slash).select(*shown).collect())) == want
        assert sorted(map(repr, fusion.expand_all(queries, rules, slash, block=3).select(*shown).collect())) == want
    assert fusion.expand_all(queries, rules.limit(0)).count() == 0


def test_expansion_shuffles_no_texts(spark):
    odd = [(1, "K-Mart İx"), (2, "k mart"), (3, "ΟΔΟΣ: a--b"), (4, "  a\tb\n_c"), (5, "naïve a b"), (6, "ma rt k"), (7, "ıx k.mart")]
    queries = spark.createDataFrame(odd, "qid long, query string")
    schema = "place int, rule string, terms array<string>, case_sensitive boolean, symbols array<string>, frameworks array<string>"
    rules = spark.createDataFrame([(0, "a", ["k mart", "K Mart", "-: -"], False, [], []), (1, "b", ["a b", "b _c", None], False, ["x"], []), (2, "c", ["ve a", "i x", ": :"], False, [], ["y"])], schema)
    found = fusion.expand_all(queries, rules)
    shown = ["qid", "rule", "symbols", "frameworks", "place"]
    assert sorted(map(repr, found.select(*shown).collect())) == sorted(map(repr, fusion.expand(queries, rules).select(*shown).distinct().collect()))
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" not in plan and plan.count("HashAggregate") == 2  # the distinct ids and rule numbers
    assert "Exchange hashpartitioning(qid" in (whole := found._jdf.queryExecution().executedPlan().toString()) and whole.count("Exchange hashpartitioning") <= 2  # the plan and its first form
    texts = queries.select(fusion.clean_words(F.col("query")).alias("a"), F.trim(fusion.clean_text(F.col("query"))).alias("b"))
    assert texts.where("a <> b").count() == 0
