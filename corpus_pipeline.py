"""From raw documents to a weighted training mix.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it as Parquet in the shared folder and reads it again for the
next stage.  All stages but the last return the columns of documents, with n_chars kept in step with the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import decontam, linededup, mixing, neardup, quality
from lodestone.llm.common import stored, table


def _measured(docs: DataFrame, columns: list[str]) -> DataFrame:
    return docs.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")).select(*columns) if "n_chars" in columns else docs.select(*columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or the trees go.

    Null and empty texts fail for want of words; null ids and repeated rows are judged like any other row; an empty table gives none; without labels the base rules decide alone.
    """
    model = quality.fit_quality(docs, table(spark, sf_dir, "labels"))
    return quality.judge(docs, model, keep=docs.columns).where("kept").select("row.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cross-site boilerplate lines go; all documents stay.

    A null text stays null; a null source is one site; a text whose lines all go stays as the empty text; repeated rows are cleaned alike; an empty table gives none.
    """
    done = linededup.dedup_lines(docs)
    return _measured(done.select(*("text" if c == "text" else F.col(f"row.`{c}`") for c in docs.columns)), docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays, the one with the smallest doc_id; of unlike texts under that id, the one of the smallest md5.

    Null and empty texts are one class; a class whose rows all lack an id keeps one; of repeated rows one stays; an empty table gives none.
    """
    return neardup.keep_first(docs, neardup.near_duplicates(docs))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans that occur in the benchmark are cut out; all documents stay.

    A null text stays null; null ids and repeated rows are cut like any other; an empty benchmark cuts nothing; an empty table gives no rows.
    """
    others = [c for c in docs.columns if c != "text"]
    found = decontam.find_contamination(docs, table(spark, sf_dir, "benchmark"), keep=others, cut=True)
    return _measured(found.select("row.*", "text"), docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many copies of each document the mix takes.

    Empty texts have size 0 and take nothing; a null source is a source of its own; ties in rank go by id, size and md5 of the text; repeated rows are documents of their own.
    """
    return mixing.mix_sources(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("near dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("mixing", mixture),
]

#: The trees, the Poisson processes and the model fits have no SQL form; tests/llm/test_pipeline.py checks the stages by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents: a row of the mixing stage for each document that is left.  Columns of documents travel along, whatever their names."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
