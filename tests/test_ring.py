"""Rings of a stream against a sort of all rows."""

import random
import time

import pytest

from lodestone.streaming import jobs, merge, ring

SCHEMA = "id int, user string, ts timestamp, note string, size long, seen timestamp"


def test_late_repeated_and_shuffled_batches(spark, tmp_path):
    rng = random.Random(31)
    stamps = [f"2024-01-01 00:{m:02d}:00" for m in range(20)]
    rows = [(i, rng.choice(["a", "b", "c", None, "hot", "hot", "hot"]), rng.choice([*stamps, None]), rng.choice(["", None, "x"]), rng.choice([None, 2**60 + 1]), rng.choice([None, stamps[3]])) for i in range(300)]
    rng.shuffle(rows)
    parts = [rows[:120], rows[60:130], rows[100:299], rows[299:], rows[:10]]
    for i, part in enumerate(parts):
        spark.createDataFrame(part, "id int, user string, ts string, note string, size long, seen string").coalesce(1).write.json(f"{tmp_path}/in/{i}")
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).json(f"{tmp_path}/in")
    ring.ring_stream(source, "user", "ts", "id", f"{tmp_path}/t", f"{tmp_path}/c", 4, buckets=2).awaitTermination(200)
    got = {(r["user"], r["place"]): (r["id"], r["note"], r["size"], r["seen"] and str(r["seen"])) for r in ring.read_rings(spark, f"{tmp_path}/t").collect()}
    want = {}
    for user in ("a", "b", "c", "hot"):
        mine = sorted(((r[2], r[0], r) for r in rows if r[1] == user and r[2]), reverse=True)[:4]
        want |= {(user, n + 1): (r[0], *r[3:]) for n, (_, _, r) in enumerate(mine)}
    assert got == want


def test_an_idle_key_starts_anew(spark, tmp_path):
    schema = "id int, user string, ts timestamp"

    def add(name, rows):
        spark.createDataFrame(rows, "id int, user string, ts string").coalesce(1).write.json(f"{tmp_path}/in/{name}")

    def wait_for(want):
        end = time.time() + 60
        while time.time() < end:
            if merge.states(spark, f"{tmp_path}/t") and {(r["user"], r["place"]): r["id"] for r in ring.read_rings(spark, f"{tmp_path}/t").collect()} == want:
                return True
            time.sleep(1)
        return False

    add("0", [(5, "a", "2024-01-05"), (6, "a", "2024-01-06"), (1, "b", "2024-01-01")])
    source = spark.readStream.schema(schema).option("recursiveFileLookup", True).json(f"{tmp_path}/in")
    running = ring.ring_stream(source, "user", "ts", "id", f"{tmp_path}/t", f"{tmp_path}/c", 2, idle_ms=1, buckets=2)
    try:
        assert wait_for({("a", 1): 6, ("a", 2): 5, ("b", 1): 1})
        time.sleep(5)  # the timers fire
        add("1", [(3, "a", "2024-01-03")])  # older than the ring that was forgotten
        assert wait_for({("a", 1): 3, ("a", 2): 5, ("b", 1): 1})
    finally:
        running.stop()


def test_a_ring_holds_something(spark):
    with pytest.raises(ValueError):
        ring.newest(spark.createDataFrame([], SCHEMA), "user", "ts", "id", 0)


def test_equal_times_are_ordered_by_the_key(spark):
    rows = spark.createDataFrame([(1, "t"), (3, "t"), (2, "t")], "id int, ts string")
    assert [r["id"] for r in jobs.ring_buffer(rows, "ts", 2, "id").collect()] == [3, 2]
