"""The newest rows of each key of a stream, kept in state: a list of at most `capacity` rows and one timer a key.

Batches may bring rows late, again, or in any order: a row enters the list if the list is not full or the row is newer than its oldest one, and a row that is there does not enter
again.  Rows of one time and identity are one row.  A row that left the list is older than all that stay, so it can't come back.  So after any batches the list holds the newest distinct rows seen.

With `idle_ms`, a key that saw no row for so long is forgotten: its state goes, and it starts anew with its next row.  Without it nothing is forgotten.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import IntegerType, StructField, StructType, TimestampType

from lodestone.streaming import merge

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Ring(StatefulProcessor):
    """Gives out the whole list of a key whenever it changed: (key, place, row...), the newest at place 1."""

    def __init__(self, columns: StructType, key: str, at: str, ident: str, capacity: int, idle_ms: int | None) -> None:
        self.columns, self.key, self.at, self.ident, self.capacity, self.idle_ms = columns, key, at, ident, capacity, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.ring = handle.getListState("ring", self.columns)

    def _age(self, row: tuple) -> tuple:
        return row[self.columns.names.index(self.at)], row[self.columns.names.index(self.ident)]

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802
        had = [tuple(r) for r in self.ring.get()] if self.ring.exists() else []
        kept = {self._age(r): r for r in had}
        for found in rows:  # one after the other, so a hot key holds no more than its ring
            row = tuple(found[c] for c in self.columns.names)
            age = self._age(row)
            if age in kept or (len(kept) == self.capacity and age < min(kept)):
                continue
            kept[age] = row
            if len(kept) > self.capacity:
                del kept[min(kept)]
        if self.idle_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        now = [kept[age] for age in sorted(kept, reverse=True)]
        if now != had:
            self.ring.put(now)
            for place, row in enumerate(now, 1):
                yield Row(place=place, **dict(zip(self.columns.names, row, strict=True)))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802
        self.ring.clear()
        return iter(())

    def close(self) -> None:
        pass


def newest(source: DataFrame, key: str, at: str, ident: str, capacity: int = 5, idle_ms: int | None = None) -> DataFrame:
    """(place, columns of source) of each key whose newest rows changed in a batch, by `at` and then `ident`; the rows of no key, time or identity are left out.

    The session's state store must be RocksDB, which lists and timers need.
    """
    if capacity < 1:
        raise ValueError("a ring holds at least one row")
    rows = source.where(F.col(key).isNotNull() & F.col(at).isNotNull() & F.col(ident).isNotNull())
    # Times go through Python as microseconds: as datetimes they would come back from state without their zone.
    stamps = [f.name for f in source.schema if isinstance(f.dataType, TimestampType)]
    plain = rows.withColumns({c: F.unix_micros(c) for c in stamps})
    schema = StructType([StructField("place", IntegerType()), *plain.schema.fields])
    kept = plain.groupBy(key).transformWithState(Ring(plain.schema, key, at, ident, capacity, idle_ms), schema, "Update", "None" if idle_ms is None else "ProcessingTime")
    return kept.withColumns({c: F.timestamp_micros(c) for c in stamps})


def ring_stream(source: DataFrame, key: str, at: str, ident: str, path: str, checkpoint: str, capacity: int = 5, idle_ms: int | None = None, buckets: int = 64) -> StreamingQuery:
    """Keeps the rings in a table under path (see lodestone.streaming.merge), a row for each key and place.  A ring that starts anew overwrites its first places only.

    The stream ends with what its source holds; with idle_ms it goes on until it is stopped, since timers may fire without new rows.
    """
    spark = source.sparkSession
    rings = newest(source, key, at, ident, capacity, idle_ms).withColumn("slot", F.struct(key, "place"))

    def fold(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            merge.merge_batch(batch, number, path, "slot", ["place"], buckets, keep_if_empty=(), arrays=(), kind="", primary="")
        finally:
            batch.unpersist()

    trigger = {"availableNow": True} if idle_ms is None else {"processingTime": "500 milliseconds"}
    before = spark.conf.get(STORE)
    spark.conf.set(STORE, ROCKS)
    try:
        return rings.writeStream.outputMode("update").foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(**trigger).start()
    finally:
        spark.conf.set(STORE, before)


def read_rings(spark, path: str) -> DataFrame:
    return merge.read_table(spark, path).drop("slot")
