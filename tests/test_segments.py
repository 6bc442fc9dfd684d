"""An index in segments against a fresh build: after changes, in its top-k, and in what it reads and writes."""

import os

import pytest
from pyspark.sql import functions as F

from lodestone.operators import fulltext
from lodestone.operators.fulltext import Phrase, plan_query
from lodestone.operators.segments import ChangedError, SegmentedIndex

WEIGHTS = {"text": 2.0, "lang": 1.0}
QUERIES = ["th en", "zzzqqq ciones", "inthe"]


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang").cache()


@pytest.fixture(scope="module")
def changed(spark, docs, tmp_path_factory):
    """Built from other texts, then brought to docs by inserts, updates and deletes, with nothing merged."""
    index = SegmentedIndex(spark, str(tmp_path_factory.mktemp("seg")), "doc_id", ["text", "lang"], factor=0)
    old = docs.where("doc_id % 5 <> 1").withColumn("text", F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("the old ention "), F.col("lang"))).otherwise(F.col("text")))
    extra = docs.limit(30).withColumn("doc_id", -1 - F.col("doc_id"))
    index.update(old.unionByName(extra))
    index.update(docs.where("doc_id % 3 = 0 AND doc_id % 2 = 0"))
    index.update(None, extra.select("doc_id"))
    assert index.sync(docs)["new"] > 0
    return index


def rounded(df):
    return sorted((r["doc"], round(r["score"], 9)) for r in df.collect())


def fresh(docs, query, match="all"):
    groups = plan_query(query)
    phrases = [p for g in groups for p in g]
    numbers, at = [], 0
    for g in groups:
        numbers.append(list(range(at, at + len(g))))
        at += len(g)
    return fulltext.bm25(docs, WEIGHTS, phrases, groups=numbers) if match == "all" else fulltext.bm25(docs, WEIGHTS, phrases, match="any")


def test_scores_equal_a_fresh_build(docs, changed):
    assert len(changed.manifest()["segments"]) == 3  # one that only deletes is merged at once
    assert changed.manifest()["rows_all"] == docs.count()
    for query in QUERIES:
        for match in ("all", "any"):
            want = sorted((r["doc_id"], round(r["score"], 9)) for r in fresh(docs, query, match).collect())
            assert rounded(changed.search(WEIGHTS, plan_query(query), match)) == want
    assert changed.sync(docs) == {}
    assert changed.difference(docs.where("doc_id <> 4").withColumn("text", F.when(F.col("doc_id") == 5, "x").otherwise(F.col("text")))).count() == 2


def test_phrases(docs, changed):
    groups = [[Phrase(("of", "the"))], [Phrase(("in", "th"), True)]]
    want = sorted((r["doc_id"], round(r["score"], 9)) for r in fulltext.bm25(docs, WEIGHTS, [g[0] for g in groups], match="any").collect())
    assert rounded(changed.search(WEIGHTS, groups, "any")) == want


@pytest.mark.parametrize("query", QUERIES)
def test_top_k(docs, changed, query):
    for match in ("all", "any"):
        every = {r["doc_id"]: r["score"] for r in fresh(docs, query, match).collect()}
        for k in (3, 20, 10_000):
            got = [(r["doc"], r["score"]) for r in changed.top(WEIGHTS, plan_query(query), k, match).collect()]
            assert [s for _, s in got] == pytest.approx(sorted(every.values(), reverse=True)[:k], rel=1e-12)
            assert all(every[doc] == pytest.approx(score, rel=1e-12) for doc, score in got)


def test_merging_changes_nothing_and_drops_the_dead(spark, docs, changed, tmp_path):
    os.system(f"cp -r {changed.path} {tmp_path}/copy")
    index = SegmentedIndex(spark, f"{tmp_path}/copy", "doc_id", ["text", "lang"])
    before = {q: rounded(index.top(WEIGHTS, plan_query(q), 20)) for q in QUERIES}
    last_two = SegmentedIndex(spark, index.path, "doc_id", ["text", "lang"], factor=1)
    assert last_two.merge() >= 0
    assert {q: rounded(index.top(WEIGHTS, plan_query(q), 20)) for q in QUERIES} == before
    index.merge(everything=True)
    (one,) = index.manifest()["segments"]
    assert one["rows"] == docs.count() and spark.read.parquet(f"{index.path}/{one['folder']}/gone").count() == 0
    assert {q: rounded(index.top(WEIGHTS, plan_query(q), 20)) for q in QUERIES} == before
    index.expire(1)
    assert [d for d in os.listdir(index.path) if d.startswith("seg-")] == [one["folder"]]


def test_a_change_writes_its_own_segment_only(spark, docs, changed):
    def files():
        return {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, fs in os.walk(changed.path) for f in fs}

    before = files()
    changed.update(docs.where("doc_id = 7"))
    after = files()
    assert all(after[f] == t for f, t in before.items())
    newest = changed.manifest()["segments"][-1]["folder"]
    assert all(newest in f or "/versions/" in f for f in after.keys() - before.keys())


def test_writers_do_not_overwrite_each_other(spark, docs, changed):
    old = changed.manifest()
    with pytest.raises(ChangedError):
        changed._commit(old)
    with pytest.raises(ValueError):
        changed.update(docs.where("doc_id = 3").unionByName(docs.where("doc_id = 3")))
    assert changed.manifest() == old


def test_an_empty_index(spark, tmp_path):
    index = SegmentedIndex(spark, str(tmp_path), "doc_id", ["text"])
    assert index.search({"text": 1.0}, plan_query("a")).count() == 0 and index.top({"text": 1.0}, plan_query("a"), 5).count() == 0
    index.update(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string"))
    assert index.top({"text": 1.0}, plan_query("a"), 5).count() == 0 and index.live().count() == 2


def scanned(df, name):
    """Rows that scans of a table gave out, by the metrics of the plan that ran."""
    df.collect()
    plan, rows = df._jdf.queryExecution().executedPlan(), 0
    stack = [plan]
    while stack:
        node = stack.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            stack.append(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            stack.append(node.plan())
        elif kind == "FileSourceScanExec" and node.relation().location().rootPaths().head().getName() == name:
            rows += node.metrics().apply("numOutputRows").value()
        kids = node.children()
        stack += [kids.apply(i) for i in range(kids.size())]
    return rows


def test_top_k_reads_fewer_postings(spark, tmp_path):
    """Many documents name a word once, few name it often: the bound of the others is below the best ones."""
    rows = spark.range(60_000).selectExpr("id AS doc_id", "concat(repeat('rare ', CASE WHEN id % 2 = 0 THEN 0 WHEN id % 3000 = 7 THEN 9 ELSE 1 END), repeat('pad ', CAST(id % 50 AS INT)), id % 3) AS text").where("id % 7 <> 4")
    index = SegmentedIndex(spark, str(tmp_path), "doc_id", ["text"])
    index.update(rows)
    groups = plan_query("rare")
    best = index.top({"text": 1.0}, groups, 10)
    every = index.search({"text": 1.0}, groups).orderBy(F.col("score").desc(), "doc").limit(10).select("doc", "score")
    assert rounded(best) == rounded(every)
    assert scanned(best, "postings") * 4 < scanned(every, "postings")
