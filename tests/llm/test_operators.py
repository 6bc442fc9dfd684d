"""Every query against SQL or brute force, on the generated tables, on odd rows and on empty tables."""

import pytest
from pyspark.sql import functions as F

from lodestone.llm import registry

from ..compare import assert_same
from . import brute


def connect(path):
    import duckdb

    con = duckdb.connect()
    import os

    for t in ("documents", "labels", "benchmark", "pages", "conversations"):
        p = f"{path}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


def plain(rows):
    return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows), key=repr)


def documents(spark, path):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{path}/documents.parquet").collect()]


def run(spark, name, path, *columns):
    return plain(tuple(r) for r in registry.QUERIES[name](spark, path).select(*columns).collect())


@pytest.fixture(params=["sf", "odd", "empty"])
def path(request, sf_dir, odd_dir, empty_dir):
    return {"sf": sf_dir, "odd": odd_dir, "empty": empty_dir}[request.param]


#: SQL joins documents by id, so tables whose ids repeat have their own tests below.
BY_ID = {"op2_line_dedup", "op5_decontamination", "op7_mixing"}


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_against_sql(spark, path, odd_dir, name):
    if name in BY_ID and path == odd_dir:
        pytest.skip("ids repeat here")
    if name == "op1_warc" and path == odd_dir:
        pytest.skip("repeated rows are tested below")
    assert_same(registry.QUERIES[name](spark, path), connect(path), registry.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(registry.QUERIES.keys() - {"op13_prefix_trie"}))  # a row for each node
def test_a_row_for_each_input(spark, odd_dir, empty_dir, name):
    table = {"op1_warc": "pages", "op12_url_filters": "pages", "op4_chat_formatting": "conversations"}.get(name, "documents")
    for p in (odd_dir, empty_dir):
        rows = spark.read.parquet(f"{p}/{table}.parquet")
        want = rows.select("conv_id").distinct().count() + 1 if table == "conversations" else rows.count()
        assert registry.QUERIES[name](spark, p).count() == want


def test_base_rules(spark, path):
    want = plain((d, *brute.base_counts(t)) for d, t in documents(spark, path))
    got = run(spark, "op3_quality_rules", path, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert got == want
    flags = registry.QUERIES["op3_quality_rules"](spark, path).select("n_words", "n_repeat_words", "base_failed", "kept").collect()
    assert all(r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"]) for r in flags)
    assert not any(r["base_failed"] and r["kept"] for r in flags)


def test_decontamination(spark, path):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{path}/benchmark.parquet").collect()]
    want = plain(brute.hits(documents(spark, path), items))
    assert run(spark, "op5_decontamination", path, "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == want


def test_language_model(spark, path):
    want = plain(brute.language_model(documents(spark, path)))
    assert run(spark, "op6_lm_scoring", path, "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score") == want


def test_suffix_dedup(spark, path):
    want = plain(brute.repeats(documents(spark, path)))
    assert run(spark, "op8_suffix_dedup", path, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == want


def test_near_duplicates(spark, path):
    want = plain(brute.near_classes(documents(spark, path)))
    assert run(spark, "op10_minhash", path, "doc_id", "class_id") == want


def test_mixing_targets(spark, path):
    rows = registry.QUERIES["op7_mixing"](spark, path).collect()
    sizes = {(d, t or ""): len(brute.WORD.findall(t or "")) for d, t in documents(spark, path)}
    assert sorted(r["size"] for r in rows) == sorted(len(brute.WORD.findall(t or "")) for _, t in documents(spark, path)) or not sizes
    assert all(r["taken"] in (0, r["size"], 2 * r["size"]) for r in rows)
    again = registry.QUERIES["op7_mixing"](spark, path).collect()
    assert plain(rows) == plain(again)
    total = sum(r["size"] for r in rows)
    targets = {r["source"]: (r["target"], r["source_size"]) for r in rows}
    assert sum(t for t, _ in targets.values()) == pytest.approx(1.5 * total)
    assert all(t <= 2 * s + 1e-6 for t, s in targets.values())


def test_mixing_meets_targets(spark, sf_dir):
    rows = registry.QUERIES["op7_mixing"](spark, sf_dir).collect()
    for source in {r["source"] for r in rows}:
        own = [r for r in rows if r["source"] == source]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= max(r["size"] for r in own) / 2 + 1


def test_warc_repeated_and_null_ids(spark, odd_dir):
    got = {(r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"]) for r in registry.QUERIES["op1_warc"](spark, odd_dir).collect()}
    assert got == {(1, "response", None, 200), (2, "revisit", 1, 200), (3, "response", None, 5), (4, "response", None, 5), (5, "response", None, 0), (None, "revisit", 1, 200), (6, "response", None, 120)}


def test_classifier_on_held_out_rows(spark, sf_dir):
    rows = registry.QUERIES["op9_quality_classifier"](spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    got = rows.join(labels, "doc_id").collect()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    held = [r for r in got if r["held_out"]]
    good, bad = [r["score"] for r in held if r["quality"] == 1], [r["score"] for r in held if r["quality"] == 0]
    assert held and sum(g > b for g in good for b in bad) >= 0.9 * len(good) * len(bad)


def test_scores_do_not_see_held_out_labels(spark, sf_dir, tmp_path):
    """Turning the held-out labels round changes nothing."""
    from lodestone.llm.common import folds

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    labels.withColumn("quality", F.when(folds(F.col("doc_id"), 5) == 0, 1 - F.col("quality")).otherwise(F.col("quality"))).write.parquet(f"{tmp_path}/labels.parquet")
    name = "op9_quality_classifier"
    assert run(spark, name, sf_dir, "doc_id", "score") == run(spark, name, str(tmp_path), "doc_id", "score")
