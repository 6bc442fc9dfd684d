"""Queries whose rows come through Structured Streaming, over streams that are dealt out of the given tables."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.plans.bindings import table
from lodestone.plans.ingest_queries import UPSERT, line_items
from lodestone.plans.registry import query
from lodestone.sources.catalog import ensure_checkpoint_dir
from lodestone.streaming import merge, ring


def cut_waves(rows: DataFrame, by: str, waves: int) -> list[DataFrame]:
    """The rows in quantiles of `by`, in order; nulls first."""
    cuts = rows.agg(F.percentile_approx(by, [i / waves for i in range(1, waves)])).first()[0] or []  # waves - 1 values
    cuts, out = sorted(set(cuts)), []
    for i in range(len(cuts) + 1):
        kept = F.lit(True)
        if i:
            kept = kept & (F.col(by) > F.lit(cuts[i - 1]))
        if i < len(cuts):
            kept = kept & ((F.col(by) <= F.lit(cuts[i])) | (F.col(by).isNull() if i == 0 else F.lit(False)))
        out.append(rows.where(kept))
    return out


def dealt(rows: DataFrame, by: str, key: str, path: str, waves: int = 4) -> DataFrame:
    """A file stream of the rows in about as many micro-batches as waves.  Waves are quantiles of `by` and are written one after the other; in a wave the rows of a key share a file, so they arrive together."""
    for i, wave in enumerate(cut_waves(rows, by, waves)):
        wave.repartition(key).write.parquet(f"{path}/{i}")
    spark = rows.sparkSession
    files = len(spark.read.option("recursiveFileLookup", True).parquet(path).inputFiles())
    return spark.readStream.schema(rows.schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", max(1, math.ceil(files / waves))).parquet(path)


def _folder(spark: SparkSession) -> str:
    return f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"


@query("i01_merge_stream", UPSERT)
def i01_stream(spark, d):
    """The upsert of line items, brought in by ship date through a stream that rewrites only the buckets of each batch."""
    path = _folder(spark)
    rows = line_items(spark, d)
    for i, wave in enumerate(cut_waves(rows.withColumn("day", F.col("at.l_shipdate")), "day", 4)):
        # A wave is written before the stream goes on from its checkpoint, so it is one micro-batch, and its rows are not shuffled to share files.
        wave.drop("day").write.parquet(f"{path}/in/{i}")
        source = spark.readStream.schema(rows.schema).option("recursiveFileLookup", True).parquet(f"{path}/in")
        merge.merge_stream(source, "id", ["at"], f"{path}/table", f"{path}/checkpoint", keep_order=False).awaitTermination()
    return merge.read_table(spark, f"{path}/table").select("id", "kind", "is_primary", "abstract", "title")


@query("w06_ring_stream", "SELECT event_id, user_id, place FROM (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS place FROM events) WHERE place <= 5")
def w06_stream(spark, d):
    """The newest events of each user, from a stream that brings them in order of their ids' hashes, so out of the order of time."""
    path = _folder(spark)
    rows = table(spark, d, "events").select("event_id", "user_id", "ts").withColumn("turn", F.xxhash64("event_id"))
    source = dealt(rows, "turn", "user_id", f"{path}/in").drop("turn")
    ring.ring_stream(source, "user_id", "ts", "event_id", f"{path}/table", f"{path}/checkpoint").awaitTermination()
    return ring.read_rings(spark, f"{path}/table").select("event_id", "user_id", F.col("place").cast("long").alias("place"))
