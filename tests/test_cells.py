"""Neighbours from cells against the search of all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import cells, vectorsearch


def by_place(df, key):
    return sorted((r["qid"], r["place"], r[key], round(r["sim"], 9)) for r in df.collect())


@pytest.fixture(scope="module")
def rows(spark, sf_dir):
    rng = random.Random(8)
    middles = [[rng.gauss(0, 1) for _ in range(12)] for _ in range(9)]
    near = [(10_000 + i, [x + rng.gauss(0, 0.15) for x in middles[i % 9]], 0) for i in range(900)]
    odd = [(20_000, [0.0] * 12, 0), (20_001, [0.0] * 12, 0), (20_002, None, 0), (20_003, [], 0), (20_004, [1.0, 2.0], 0), (20_005, [2.0, 4.0], 0), (20_020, [3.0, -1.0], 0), (20_007, near[3][1], 0), (20_008, near[3][1], 0)]
    made = spark.createDataFrame(near + odd, "vec_id long, embedding array<float>, label int")
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").unionByName(made).cache()


@pytest.mark.parametrize("most_cells,chunk_bytes", [(16, 2048), (1, 1 << 20)])
def test_equal_to_all_pairs(spark, rows, tmp_path, most_cells, chunk_bytes):
    cells.build_cells(rows, "vec_id", str(tmp_path), cells=most_cells, sample=500, chunk_bytes=chunk_bytes)
    assert spark.read.parquet(f"{tmp_path}/chunks").agg(F.sum(F.size("ids"))).first()[0] == rows.where("size(embedding) > 0").count()
    queries = rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"))
    for k in (1, 10):
        found, reads = cells.nearest_in_cells(spark, str(tmp_path), queries, k)
        want = vectorsearch.nearest_by_row(rows, queries, "vec_id", k)
        assert by_place(found.withColumnRenamed("id", "vec_id"), "vec_id") == by_place(want, "vec_id")
        r = reads.first()
        assert 0 < r["met"] <= r["every"]
        if most_cells > 1 and k == 1:
            assert r["met"] < r["every"]


def test_close_groups_are_pruned(spark, rows, tmp_path):
    close = rows.where("vec_id >= 10000 AND vec_id < 20000")
    cells.build_cells(close, "vec_id", str(tmp_path), cells=9, sample=500, chunk_bytes=4096)
    queries = close.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"))
    found, reads = cells.nearest_in_cells(spark, str(tmp_path), queries, 5)
    assert by_place(found.withColumnRenamed("id", "vec_id"), "vec_id") == by_place(vectorsearch.nearest_by_row(close, queries, "vec_id", 5), "vec_id")
    r = reads.first()
    assert r["met"] * 2 < r["every"]
