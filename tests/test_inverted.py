"""What the stored indexes hold: a row for a term and a group of documents, not one for each token or trigram of a text."""

from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from lodestone.operators import fulltext, grams
from lodestone.operators.segments import SegmentedIndex


def texts(spark):
    return spark.range(0, 300, 1, 2).selectExpr("id AS doc_id", "concat(repeat('again ', 5), 'rare', id % 3) AS text")


def test_postings_of_an_index(spark, tmp_path):
    fulltext.build_index(texts(spark), "doc_id", ["text"], str(tmp_path / "i"))
    postings = spark.read.parquet(str(tmp_path / "i/postings"))
    assert postings.count() <= 8  # four terms in two partitions; 1,800 tokens
    assert postings.agg(F.sum(F.size("places"))).first()[0] == 1800
    assert spark.read.parquet(str(tmp_path / "i/lengths")).where("dl = 6").count() == 300


def test_postings_are_written_once(spark, tmp_path, monkeypatch):
    written, write = [], DataFrameWriter.parquet

    def counted(self, path, *args, **more):
        write(self, path, *args, **more)
        written.append(spark.read.parquet(path).count())

    monkeypatch.setattr(DataFrameWriter, "parquet", counted)
    fulltext.build_index(texts(spark), "doc_id", ["text"], str(tmp_path / "i"))
    postings = spark.read.parquet(str(tmp_path / "i/postings"))
    assert sum(written) <= postings.count() + 2 + 300 + 1  # lengths of two batches, those of 300 documents, totals
    assert postings.columns == ["term", "col", "docs", "counts", "places"] and postings.where("term IS NULL").count() == 0


def test_index_of_texts_without_a_token(spark, tmp_path):
    for name, rows, most in (("none", texts(spark).limit(0), 0), ("blank", texts(spark).withColumn("text", F.lit(" . ")), 300)):
        fulltext.build_index(rows, "doc_id", ["text"], str(tmp_path / name))
        assert spark.read.parquet(str(tmp_path / name / "lengths")).where("dl = 0").count() == most
        found = fulltext.search_index(spark, str(tmp_path / name), {"text": 1.0}, [[fulltext.Phrase.of("again")]])
        assert found.count() == 0


def test_postings_of_a_segment(spark, tmp_path):
    index = SegmentedIndex(spark, str(tmp_path / "s"), "doc_id", ["text"])
    index.update(texts(spark))
    (one,) = index.manifest()["segments"]
    postings = spark.read.parquet(f"{index.path}/{one['folder']}/postings")
    assert postings.count() <= 4 * 4  # four terms, two buckets in each of two partitions
    assert postings.agg(F.sum(F.size("places"))).first()[0] == 1800


def test_postings_of_trigrams(spark, tmp_path):
    grams.build_grams(texts(spark), "doc_id", ["text"], str(tmp_path / "g"))
    postings = spark.read.parquet(str(tmp_path / "g/postings"))
    assert postings.count() <= 2 * postings.select("gram").distinct().count()
    assert postings.where("gram = 'gai'").agg(F.sum(F.size("docs"))).first()[0] == 300


def test_a_task_holds_the_best_of_each_query_only():
    import numpy as np
    import pyarrow as pa

    from lodestone.operators.vectorsearch import _best

    held = None
    for start in range(0, 1000, 10):
        ids = np.arange(start, start + 10)
        held = _best(held, ids % 2, pa.array(ids), (ids % 500) / 500, 3)
        assert len(held[0]) <= 2 * 4  # two queries, three rows and a tie
    assert sorted(held[1].to_pylist()) == [496, 497, 498, 499, 996, 997, 998, 999]
