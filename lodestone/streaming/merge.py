"""A keyed table that a stream keeps: a micro-batch rewrites only the hash buckets its keys fall into.

Under the table's folder lie `rows/merge_version=N/merge_bucket=B`, written by batch N, and `state/N`, the live version of each bucket after batch N:
at most one row a bucket.  A state counts once its success mark stands, so a reader sees one state or the next, and a batch that runs again
after a loss starts from the state before it.  Versions are deleted when neither the new state nor the one before it names them, so a reader that has
opened a table may go on for one more batch.

The numbers of batches come from the stream's checkpoint, so table and checkpoint belong together.  A batch whose state stands is not folded in
again; a batch older than the table is an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestone.operators import ingest
from lodestone.sources import store

VERSION, BUCKET = "merge_version", "merge_bucket"
OWN = (VERSION, BUCKET, "merge_new")
HOT_ROWS = 100_000  # of a bucket in a batch; fewer are never much


def bucket_of(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def states(spark: SparkSession, path: str) -> list[int]:
    """The numbers of the whole states, ascending."""
    return sorted(int(name) for name in store.names(spark, f"{path}/state") if store.exists(spark, f"{path}/state/{name}/_SUCCESS"))


def live(spark: SparkSession, path: str, number: int) -> dict[int, int]:
    """The live version of each bucket in a state."""
    return {r["bucket"]: r["version"] for r in spark.read.parquet(f"{path}/state/{number}").select("bucket", "version").collect()}  # a row a bucket


def _rows(spark: SparkSession, path: str, versions: dict[int, int]) -> DataFrame | None:
    paths = [f"{path}/rows/{VERSION}={v}/{BUCKET}={b}" for b, v in sorted(versions.items())]
    return spark.read.option("basePath", f"{path}/rows").parquet(*paths).drop(VERSION) if paths else None


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the last state."""
    found = states(spark, path)
    rows = _rows(spark, path, live(spark, path, found[-1])) if found else None
    if rows is None:
        raise ValueError(f"no batch was merged into {path} yet")
    return rows.drop(BUCKET)


def merge_batch(batch: DataFrame, number: int, path: str, key: str, order: list[str], buckets: int = 64, keep_order: bool = True, **rules) -> list[int]:
    """Folds a batch into the table by ingest.upsert (`rules` are its further parameters), old rows before new ones, and returns the buckets it rewrote.

    A null key is a key like others.  An empty batch writes nothing, a repeated one nothing either.  The number of buckets is the table's for good, and so is whether it keeps
    the columns of the order, which only decide inside a batch.
    """
    if clash := sorted(set(OWN) & set(batch.columns)):
        raise ValueError(f"columns {clash} are the table's own")
    spark, found = batch.sparkSession, states(batch.sparkSession, path)
    if found and number <= found[-1]:
        if number == found[-1]:
            return []
        raise ValueError(f"batch {number} is older than state {found[-1]} of {path}: the table belongs to another checkpoint")
    before = live(spark, path, found[-1]) if found else {}
    if found and (had := spark.read.parquet(f"{path}/state/{found[-1]}").first()["buckets"]) != buckets:
        raise ValueError(f"{path} has {had} buckets, not {buckets}")
    fresh = batch.withColumn(BUCKET, bucket_of(key, buckets))
    sizes = dict(fresh.groupBy(BUCKET).count().collect())  # at most `buckets` rows
    touched = sorted(sizes)
    if not touched:
        return []
    keys, dropped = [BUCKET, key], () if keep_order else tuple(c for c in order if c != key)
    # Buckets of far more rows than others hold keys that come very often: those are folded by key, where they are first, before they meet.
    if hot := [b for b, n in sizes.items() if n > HOT_ROWS and n > 4 * sum(sizes.values()) / buckets]:
        often = F.col(BUCKET).isin(hot)
        fresh = fresh.where(~often).unionByName(ingest.upsert(fresh.where(often), keys, order, **rules))
    old, fresh = _rows(spark, path, {b: before[b] for b in touched if b in before}), fresh.withColumn("merge_new", F.lit(1))
    every = fresh if old is None else fresh.unionByName(old.withColumn("merge_new", F.lit(0)), allowMissingColumns=not keep_order)
    # One shuffle: rows meet by bucket, and a bucket's keys are folded where they met; a bucket is a file.
    merged = ingest.upsert(every.repartition(BUCKET), keys, ["merge_new", *order], **rules, without=("merge_new", *dropped))
    merged.write.mode("overwrite").partitionBy(BUCKET).parquet(f"{path}/rows/{VERSION}={number}")
    after = before | {b: number for b in touched}
    spark.createDataFrame([(b, v, buckets) for b, v in sorted(after.items())], "bucket int, version long, buckets int").coalesce(1).write.mode("overwrite").parquet(f"{path}/state/{number}")
    _expire(spark, path, found, set(before.items()) | set(after.items()))
    return touched


def _expire(spark: SparkSession, path: str, earlier: list[int], kept: set[tuple[int, int]]) -> None:
    """Deletes states but the last of the earlier ones, and versions of buckets that no kept state names."""
    for number in earlier[:-1]:
        store.delete(spark, f"{path}/state/{number}")
    alive = {v for _, v in kept}
    for version in store.names(spark, f"{path}/rows"):
        v = int(version.split("=")[1])
        if v not in alive:
            store.delete(spark, f"{path}/rows/{version}")
            continue
        for name in store.names(spark, f"{path}/rows/{version}"):
            if name.startswith(f"{BUCKET}=") and (int(name.split("=")[1]), v) not in kept:
                store.delete(spark, f"{path}/rows/{version}/{name}")


def merge_stream(source: DataFrame, key: str, order: list[str], path: str, checkpoint: str, buckets: int = 64, keep_order: bool = True) -> StreamingQuery:
    """Every micro-batch of the source through merge_batch."""

    def fold(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            merge_batch(batch, number, path, key, order, buckets, keep_order)
        finally:
            batch.unpersist()

    return source.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
