"""A table kept by a stream against the batch upsert."""

import os
import random

import pytest
from pyspark.sql import DataFrameWriter

from lodestone.operators import ingest
from lodestone.streaming import merge

SCHEMA = "id int, seq int, kind string, abstract string, is_primary boolean"


def made(rng, n, ids):
    return [(rng.choice([None, *range(ids)]), rng.randrange(100), rng.choice(["struct", "unknown", "symbol", None, "class"]), rng.choice(["", None, "a", "b"]), rng.random() < 0.5) for _ in range(n)]


def rows_of(df):
    return sorted(map(repr, df.select("id", "seq", "kind", "abstract", "is_primary").collect()))


def batch_upsert(spark, parts):
    rows = [(*r, i, j) for i, part in enumerate(parts) for j, r in enumerate(part)]
    frame = spark.createDataFrame(rows, f"{SCHEMA}, part int, place int")
    return ingest.upsert(frame, "id", ["part", "seq", "place"])


def test_many_batches_and_replays_equal_the_batch(spark, tmp_path):
    rng, path = random.Random(5), str(tmp_path / "t")
    parts = [made(rng, n, 40) for n in (60, 1, 0, 25, 25, 3)]
    # Within a batch the place decides between rows of one seq, as it does in the batch upsert.
    frames = [spark.createDataFrame([(*r, j) for j, r in enumerate(p)], f"{SCHEMA}, place int") for p in parts]
    for number, frame in enumerate(frames):
        wrote = merge.merge_batch(frame, number, path, "id", ["seq", "place"], 8)
        assert (wrote == []) == (len(parts[number]) == 0)
        if number and parts[number]:
            assert merge.merge_batch(frame, number, path, "id", ["seq", "place"], 8) == []
    assert rows_of(merge.read_table(spark, path)) == rows_of(batch_upsert(spark, parts))
    with pytest.raises(ValueError, match="older"):
        merge.merge_batch(frames[0], 0, path, "id", ["seq", "place"], 8)
    with pytest.raises(ValueError, match="8 buckets"):
        merge.merge_batch(frames[0], 9, path, "id", ["seq", "place"], 4)


def test_a_batch_lost_before_its_state_runs_again(spark, tmp_path):
    path = str(tmp_path / "t")
    one = spark.createDataFrame([(i, 1, "class", f"t{i}", True) for i in range(50)], SCHEMA)
    two = spark.createDataFrame([(3, 2, "unknown", "new", False)], SCHEMA)
    merge.merge_batch(one, 0, path, "id", ["seq"], 8)
    merge.merge_batch(two, 1, path, "id", ["seq"], 8)
    want = rows_of(merge.read_table(spark, path))
    os.remove(f"{path}/state/1/_SUCCESS")  # the job ended between rows and state
    assert rows_of(merge.read_table(spark, path)) == rows_of(one)
    assert merge.merge_batch(two, 1, path, "id", ["seq"], 8) != []
    assert rows_of(merge.read_table(spark, path)) == want


def test_only_touched_buckets_are_written_and_old_versions_go(spark, tmp_path):
    path = str(tmp_path / "t")
    merge.merge_batch(spark.createDataFrame([(i, 1, "class", "x", True) for i in range(200)], SCHEMA), 0, path, "id", ["seq"], 16)
    for number in range(1, 6):
        before = merge.live(spark, path, number - 1)
        wrote = merge.merge_batch(spark.createDataFrame([(7, number + 1, "class", f"v{number}", True)], SCHEMA), number, path, "id", ["seq"], 16)
        assert len(wrote) == 1
        assert {b: v for b, v in merge.live(spark, path, number).items() if b not in wrote} == {b: v for b, v in before.items() if b not in wrote}
        files = [n for n in os.listdir(f"{path}/rows/merge_version={number}") if "=" in n]
        assert files == [f"merge_bucket={wrote[0]}"]
    assert sorted(os.listdir(f"{path}/rows")) == ["merge_version=0", "merge_version=4", "merge_version=5"]
    assert sorted(n for n in os.listdir(f"{path}/state")) == ["4", "5"]
    assert merge.read_table(spark, path).where("id = 7").first()["abstract"] == "v5"


def test_reserved_columns_and_empty_tables(spark, tmp_path):
    with pytest.raises(ValueError, match="merge_bucket"):
        merge.merge_batch(spark.createDataFrame([(1, 2)], "id int, merge_bucket int"), 0, str(tmp_path / "t"), "id", ["id"])
    assert merge.merge_batch(spark.createDataFrame([], SCHEMA), 0, str(tmp_path / "t"), "id", ["seq"]) == []
    with pytest.raises(ValueError, match="no batch"):
        merge.read_table(spark, str(tmp_path / "t"))


def test_stream_of_files(spark, tmp_path):
    rows = [(1, 1, "struct", "old", True), (1, 2, "unknown", "", False), (2, 1, "symbol", None, False), (2, 3, "class", "x", False), (1, 4, "symbol", "new", True)]
    for i, part in enumerate((rows[:2], rows[2:4], rows[4:])):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.json(str(tmp_path / "in" / f"{i}"))
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).json(str(tmp_path / "in"))
    merge.merge_stream(source, "id", ["seq"], str(tmp_path / "out"), str(tmp_path / "cp"), 4).awaitTermination(120)
    assert rows_of(merge.read_table(spark, str(tmp_path / "out"))) == rows_of(ingest.upsert(spark.createDataFrame(rows, SCHEMA), "id", ["seq"]))


def test_a_batch_is_shuffled_once(spark, tmp_path, monkeypatch):
    plans, write = [], DataFrameWriter.parquet

    def seen(self, path, *args, **more):
        if "/rows/" in path:
            plans.append(self._df._jdf.queryExecution().executedPlan().toString())
        write(self, path, *args, **more)

    monkeypatch.setattr(DataFrameWriter, "parquet", seen)
    for number in range(2):
        merge.merge_batch(spark.createDataFrame([(i, number, "class", "x", True) for i in range(50)], SCHEMA), number, str(tmp_path / "t"), "id", ["seq"], 8)
    assert [p.count("Exchange hashpartitioning(merge_bucket") for p in plans] == [1, 1]
    assert [p.count("Exchange") for p in plans] == [1, 1]


@pytest.mark.parametrize("keep_order", [True, False])
def test_keys_that_come_very_often(spark, tmp_path, monkeypatch, keep_order):
    monkeypatch.setattr(merge, "HOT_ROWS", 20)
    rng, path = random.Random(7), str(tmp_path / "t")
    parts = [made(rng, 60, 40) + [(7, rng.randrange(100), rng.choice(["class", "symbol"]), rng.choice(["", "a", "b"]), rng.random() < 0.5) for _ in range(200)] for _ in range(3)]
    for number, part in enumerate(parts):
        frame = spark.createDataFrame([(*r, j) for j, r in enumerate(part)], f"{SCHEMA}, place int")
        merge.merge_batch(frame, number, path, "id", ["seq", "place"], 8, keep_order)
    found, want = merge.read_table(spark, path), batch_upsert(spark, parts)
    shown = ["id", "kind", "abstract", "is_primary", *(["seq"] if keep_order else [])]
    assert set(found.columns) == {*shown, *(["place"] if keep_order else [])}
    assert sorted(map(repr, found.select(shown).collect())) == sorted(map(repr, want.select(shown).collect()))
