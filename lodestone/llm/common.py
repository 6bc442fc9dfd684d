"""Session settings, table access and small DataFrame helpers of the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, IntegerType, LongType, ShortType, StructType, _parse_datatype_string

#: A word, where an operator does not define its own: anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor shares, from spark.checkpoint.dir.  Where that is unset, a temporary one in local mode (tests), and an error on a cluster."""
    bounded_batches(spark)
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="lodestone-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def bounded_batches(spark: SparkSession, most: str = "8m") -> None:
    """Keeps an Arrow batch small where the session leaves Spark's default: long texts make 10,000 rows large on both sides of the pipe."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) in ("67108864b", "64m", "64MB"):
        spark.conf.set(name, most)


def tidy() -> None:
    """Gives freed memory back, for the worker process is kept for later tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def scratch(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str) -> DataFrame:
    """Cuts the lineage with a table in the shared folder, so that a lost executor costs no recomputation."""
    path = scratch(df.sparkSession, what)
    df.write.parquet(path)
    _folder(df.sparkSession, path).deleteOnExit(_path(df.sparkSession, path))  # what is not discarded goes with the application
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def _path(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def _folder(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def discard(*tables: DataFrame) -> None:
    """Deletes stored tables that nothing still to be computed reads."""
    for df in tables:
        _folder(df.sparkSession, df.stored_at).delete(_path(df.sparkSession, df.stored_at), True)


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def integral(docs: DataFrame, name: str) -> Column:
    """The column as long; an id of another kind is an error, for a cast would make it null."""
    if not isinstance(docs.schema[name].dataType, (ByteType, ShortType, IntegerType, LongType)):
        raise TypeError(f"{name} must be a whole number, not {docs.schema[name].dataType.simpleString()}")
    return F.col(name).cast("long").alias(name)


def folds(column, modulus: int):
    """crc32 of the id as text, modulo: the split into held-out and training rows. Null ids fall as the empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % modulus


def annotate(docs: DataFrame, fn: Callable, fields: str, keep: Sequence[str] = ("doc_id",), text: str = "text") -> DataFrame:
    """Runs fn over Arrow batches of one text column and returns struct `row` (the kept columns) beside what fn gives.

    fn takes (text array, row struct array) and returns a list of arrays in the order of `fields`, with a value for each row.
    Kept columns travel inside the struct, so their names can't clash with the new ones.
    """
    bounded_batches(docs.sparkSession)
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in keep)).alias("row"), F.col(f"`{text}`").alias("text"))
    schema = StructType([packed.schema["row"], *_parse_datatype_string(fields).fields])
    names = schema.names

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), *fn(batch.column(1), batch.column(0))], names=names)
            tidy()

    return packed.mapInArrow(run, schema)
