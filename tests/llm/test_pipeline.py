import random

import corpus_pipeline
from pyspark.sql import functions as F

from . import brute


def stages(spark, path):
    docs = [spark.read.parquet(f"{path}/documents.parquet")]
    for _, stage in corpus_pipeline.STAGES:
        docs.append(corpus_pipeline.stored(stage(spark, docs[-1], path), "stage"))
    return docs


def test_stages_by_brute_force(spark, sf_dir):
    raw, good, lines, single, clean, mix = stages(spark, sf_dir)
    for frame in (good, lines, single, clean):
        assert frame.columns == raw.columns
        assert frame.where("n_chars <> length(text)").count() == 0
    texts = lambda df: {r["doc_id"]: r["text"] for r in df.collect()}
    before, after = texts(raw), texts(good)
    for d, t in before.items():
        n, _, _, _, repeated = brute.base_counts(t)
        assert (n < 20 or 100 * repeated > 30 * n) <= (d not in after)
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    assert sum(labels.get(d) == 0 for d in after) <= 0.25 * sum(q == 0 for q in labels.values())
    fine = [d for d, q in labels.items() if q == 1 and brute.base_counts(before[d])[0] >= 20 and 100 * brute.base_counts(before[d])[4] <= 30 * brute.base_counts(before[d])[0]]
    assert all(d in after for d in fine)

    assert texts(lines).keys() == after.keys()
    want = brute.near_classes(sorted(texts(lines).items()))
    assert set(texts(single)) == {d for d, c in want if d == c}

    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    hit = {d for d, _, n, *_ in brute.hits(sorted(texts(single).items()), items) if n}
    assert {d for d, t in texts(clean).items() if t != texts(single)[d]} == hit and texts(clean).keys() == texts(single).keys()

    assert {r["doc_id"] for r in mix.collect()} == set(texts(clean))
    assert mix.agg(F.sum("taken")).first()[0] > 0


def test_run_gives_the_last_stage(spark, sf_dir):
    a, b = corpus_pipeline.run(spark, sf_dir), stages(spark, sf_dir)[-1]
    assert sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))


def test_odd_and_empty_tables(spark, odd_dir, empty_dir):
    assert corpus_pipeline.run(spark, empty_dir).count() == 0
    for frame in stages(spark, odd_dir)[1:5]:
        assert "score" in frame.columns and "row" in frame.columns


def test_line_dedup_takes_blocks_and_keeps_copies(spark, tmp_path):
    """A block of two lines at the end of unlike texts goes, also where most of its occurrences are copies; near copies keep their lines."""
    rng = random.Random(11)
    own = lambda n: " ".join(rng.choice("abcdefghij") + str(rng.randrange(500)) for _ in range(n))
    block, rows = "read more of this here\nall rights are kept by us", []
    for i in range(24):
        rows.append((i, f"{own(30)}\n{own(30)}\n{block}", f"s{i % 12}"))
    copied = f"{own(30)}\n{own(30)}\n{block}"
    rows += [(100 + i, copied, f"s{i % 12}") for i in range(60)]
    lines = [own(20) for _ in range(8)]
    rows += [(200 + i, "\n".join([*lines[: i % 8], lines[i % 8] + f" x{i}", *lines[i % 8 + 1 :]]), f"s{i % 12}") for i in range(24)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    done = {r["doc_id"]: r["text"] for r in corpus_pipeline.line_dedup(spark, frame, str(tmp_path)).collect()}
    assert done == {d: t.removesuffix("\n" + block) for d, t, _ in rows}
