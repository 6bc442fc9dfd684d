"""Structured Streaming forms: incremental postings, sessions, and redacted log fan-out with a ring buffer.  The incremental upsert is in lodestone.streaming.merge.

An extension: the batch operators are the same, and a batch that runs twice writes the same files.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestone.functions import logs
from lodestone.functions import text as T


def postings_stream(source: DataFrame, key: str, columns: list[str], path: str, checkpoint: str) -> StreamingQuery:
    """Appends postings of new rows, partitioned by batch so that a repeated batch replaces itself."""

    def add(batch: DataFrame, number: int) -> None:
        per = [batch.select(F.col(key).alias("doc"), F.lit(c).alias("col"), F.posexplode(T.tokens(F.col(c))).alias("pos", "term")) for c in columns]
        every = per[0]
        for more in per[1:]:
            every = every.unionByName(more)
        every.withColumn("batch", F.lit(number)).sortWithinPartitions("term").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)

    return source.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def redacted(events: DataFrame, least_level: str = "info") -> DataFrame:
    """Log rows (ts, level, message) at or above a level, with secrets masked: narrow, so it works on streams and tables."""
    return events.where(logs.level_number(F.col("level")) >= logs.LEVELS[least_level]).withColumn("message", T.redact(F.col("message")))


def fan_out(events: DataFrame, sinks: dict[str, Callable[[DataFrame, int], None]], checkpoint: str, least_level: str = "info") -> StreamingQuery:
    """Every sink gets each micro-batch of redacted rows."""

    def send(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            for sink in sinks.values():
                sink(batch, number)
        finally:
            batch.unpersist()

    return redacted(events, least_level).writeStream.foreachBatch(send).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ring_buffer(rows: DataFrame, order: str, capacity: int = 100, key: str | None = None) -> DataFrame:
    """The newest rows, at most 10,000: a top-k, so no task sees more than that.  Of rows of one time the greater key is the newer, if a key is named."""
    return rows.orderBy(F.col(order).desc(), *([F.col(key).desc()] if key else [])).limit(max(1, min(10_000, capacity)))


def session_counts(events: DataFrame, gap: str = "30 minutes", lateness: str = "1 hour") -> DataFrame:
    """Events of each user by session; late rows are taken up to the watermark."""
    return events.withWatermark("ts", lateness).groupBy("user_id", F.session_window("ts", gap).alias("session")).agg(F.count("*").alias("n"))
