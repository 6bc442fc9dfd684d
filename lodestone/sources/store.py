"""Where a store lies, how it is seeded, and whether it is still the one that was opened."""

from __future__ import annotations

import hashlib
import os
import time
from collections import OrderedDict
from collections.abc import Callable, Hashable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def store_path(env: Mapping[str, str], root: str, variable: str = "LODESTONE_STORE", writable: Callable[[str], bool] = lambda p: os.access(p, os.W_OK)) -> str:
    """The folder a variable names, relative to root; else root/data where that can be written; else the user's cache."""
    named = (env.get(variable) or "").strip()
    if named:
        return named if "://" in named else os.path.normpath(os.path.join(root, named))
    if writable(os.path.join(root, "data")):
        return os.path.join(root, "data", "store")
    cache = (env.get("XDG_CACHE_HOME") or "").strip() or os.path.join(env.get("HOME", "/"), ".cache")
    return os.path.join(cache, "lodestone", "store")


def _files(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    at, files = _files(spark, path)
    return files.exists(at)


def names(spark: SparkSession, path: str) -> list[str]:
    """What lies in a folder; nothing if there is none."""
    at, files = _files(spark, path)
    return [f.getPath().getName() for f in files.listStatus(at)] if files.exists(at) else []


def delete(spark: SparkSession, path: str) -> None:
    at, files = _files(spark, path)
    files.delete(at, True)


def move(spark: SparkSession, path: str, to: str) -> None:
    """Renames a folder; what lay there before goes."""
    at, files = _files(spark, path)
    target = _files(spark, to)[0]
    files.delete(target, True)
    if not files.rename(at, target):
        raise OSError(f"{path} could not be moved to {to}")


def touch(spark: SparkSession, path: str) -> None:
    """An empty file that marks its folder as whole; the folder goes when the application ends."""
    at, files = _files(spark, path)
    files.create(at, True).close()
    files.deleteOnExit(at.getParent())


def readable(spark: SparkSession, path: str) -> bool:
    """Whether the files under path open as Parquet: only footers are read."""
    at, files = _files(spark, path)
    if not files.exists(at):
        return False
    try:
        return len(spark.read.parquet(path).schema) > 0
    except Exception as e:
        if type(e).__module__.startswith("pyspark") or "java" in str(e):
            return False
        raise


def snapshot(spark: SparkSession, path: str) -> str:
    """A digest of names, sizes and times of a table's files; one listing, no data."""
    at, files = _files(spark, path)
    found, each = [], files.listFiles(at, True)
    while each.hasNext():
        status = each.next()
        found.append(f"{status.getPath().getName()} {status.getLen()} {status.getModificationTime()}")
    return hashlib.sha256("\n".join(sorted(found)).encode()).hexdigest()


class ReplacedError(RuntimeError):
    """The store was replaced after it was opened."""


def guard(spark: SparkSession, path: str, opened: str) -> None:
    if snapshot(spark, path) != opened:
        raise ReplacedError(f"{path} is no longer what was opened; open it again")


def seed(spark: SparkSession, source: str, target: str, tables: Sequence[str] = ("symbols", "vectors"), stamp: str = "meta") -> bool:
    """Copies a store unless the target was built at the same time; each table appears whole or not at all, and the stamp last."""

    def built(path: str):
        if not readable(spark, f"{path}/{stamp}"):
            return None
        rows = spark.read.parquet(f"{path}/{stamp}").where("key = 'built_at'").select("value").take(1)
        return rows[0][0] if rows else None

    if built(target) is not None and built(target) == built(source):
        return False
    for name in (*tables, stamp):
        spark.read.parquet(f"{source}/{name}").write.mode("overwrite").parquet(f"{target}/{name}")
    return True


def hydrate_once(vectors: DataFrame, obtain: Callable[[], DataFrame]) -> DataFrame:
    """vectors, or what obtain() gives where there are none."""
    return obtain() if vectors.isEmpty() else vectors


def schema_snapshot(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(table_name, column_name, type, rows): one count a table."""
    out = None
    for name, df in tables.items():
        columns = F.array(*(F.struct(F.lit(f.name).alias("column_name"), F.lit(f.dataType.simpleString()).alias("type")) for f in df.schema.fields))
        one = df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table_name"), F.explode(columns).alias("c"), "rows").select("table_name", "c.*", "rows")
        out = one if out is None else out.unionByName(one)
    return out


class TtlCache:
    """The most recently used values, each for a limited time."""

    def __init__(self, most: int = 500, seconds: float = 600.0, clock: Callable[[], float] = time.monotonic):
        self.most, self.seconds, self.clock, self.held = most, seconds, clock, OrderedDict()

    def get(self, key: Hashable, make: Callable[[], object] | None = None):
        found = self.held.get(key)
        if found and self.clock() < found[0]:
            self.held.move_to_end(key)
            return found[1]
        self.held.pop(key, None)
        if make is None:
            return None
        self.put(key, make())
        return self.held[key][1]

    def put(self, key: Hashable, value) -> None:
        self.held[key] = (self.clock() + self.seconds, value)
        self.held.move_to_end(key)
        while len(self.held) > self.most:
            self.held.popitem(last=False)
