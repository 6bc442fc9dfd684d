"""The tree of openings against plain Python, on given, odd, long and nested conversations."""

import math
import random
import zlib

import pytest

from lodestone.llm import convtrie, registry

from ..compare import assert_same
from .brute import WORD, sha
from .test_operators import connect, path, plain, run  # noqa: F401

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def tree(rows):
    """rows (conv_id, turn, role, text)."""
    talk = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            talk.setdefault(c, []).append(((turn is not None, turn or 0), sha(f"{len(role)}:{role}{text}"), role, text))
    talk = {c: [(t[2], t[3]) for t in sorted(ts)] for c, ts in talk.items()}
    whole = {}
    for c, own in talk.items():
        h = zlib.crc32(str(c).encode()) % 4
        whole[c] = tuple(talk.get(c - int(math.fmod(c, 20)), [])[:h] + own[h:])
    members = {}
    for c, ts in whole.items():
        for d in range(len(ts) + 1):
            members.setdefault(ts[:d], []).append(c)
    out = []
    for node, cs in members.items():
        below = [x for x in members if x[: len(node)] == node]
        children = {x for x in below if len(x) == len(node) + 1}
        saved = sum((len(members[x]) - 1) * len(WORD.findall(x[-1][1])) for x in below if x)
        leaves = sum(not any(len(y) == len(x) + 1 and y[: len(x)] == x for y in below) for x in below)
        ends = sorted(c for c in cs if len(whole[c]) == len(node))
        out.append((min(cs), len(node), min(members[node[:-1]]) if node else None, len(cs), len(children), leaves, saved, sha(",".join(map(str, ends)))))
    return out


def table_of(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def test_whole_results(spark, path):  # noqa: F811
    rows = [tuple(r) for r in spark.read.parquet(f"{path}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert run(spark, "op13_prefix_trie", path, *COLUMNS) == plain(tree(rows))


def nested(seed, convs, deep):
    rng = random.Random(seed)
    rows = []
    for c in range(-5, convs):
        rows += [(c, t, "ab"[t % 2], f"w {rng.randrange(2)}") for t in range(rng.randrange(1, deep))]
    return rows


@pytest.mark.parametrize("rows", [nested(1, 150, 12), [(7, 0, "u", "only one")], [(21, t, "u", "x") for t in range(2)] + [(23, 0, "u", "y")], [(40 + i, t, "u", f"{t}") for i in range(30) for t in range(3 + i // 3)]])
def test_nested_chains(spark, rows):
    rng = random.Random(2)
    rng.shuffle(rows)
    assert plain(map(tuple, convtrie.prefix_tree(table_of(spark, rows)).select(*COLUMNS).collect())) == plain(tree(rows))


def test_long_conversation_is_dealt_over_tasks(spark):
    rows = [(20, t, "u", f"turn {t % 7}") for t in range(300)] + [(21, t, "u", f"turn {t % 7}") for t in range(290)] + [(22, t, "u", "z" * 1000) for t in range(3)]
    turns = convtrie.numbered(table_of(spark, rows)).where("conv = 20")
    assert turns.select("part").distinct().count() > 1
    assert [r["pos"] for r in turns.orderBy("pos").collect()] == list(range(300))
    got = convtrie.prefix_tree(table_of(spark, rows)).select(*COLUMNS).collect()
    assert plain(map(tuple, got)) == plain(tree(rows))


def test_sums_run_over_blocks_of_depths(spark):
    rows = spark.range(10_000).selectExpr("id % 2 AS conv", "id div 2 AS d", "1L AS leaves")
    assert convtrie.up_the_chain(rows, "leaves").where("leaves <> 5000 - d").count() == 0


def test_ids_are_hashed_in_blocks(spark):
    ids = [*range(-9000, 12_000, 3)]
    got = convtrie.hashed_ids(spark.createDataFrame([(1, 2, i) for i in ids] + [(1, 3, 5), (0, 2, 9)], "conv long, d long, id long")).collect()
    assert {(r["conv"], r["d"]): r["ends_sha256"] for r in got} == {(1, 2): sha(",".join(map(str, ids))), (1, 3): sha("5"), (0, 2): sha("9")}


def test_extra_columns(spark, odd_dir):
    rows = spark.read.parquet(f"{odd_dir}/conversations.parquet")
    more = rows.selectExpr("*", "1 AS conv", "2 AS d", "'x' AS print", "3 AS words", "4 AS part")
    assert plain(map(tuple, convtrie.prefix_tree(more).select(*COLUMNS).collect())) == plain(tree([tuple(r) for r in rows.select("conv_id", "turn", "role", "text").collect()]))


def test_sql(spark, sf_dir):
    assert_same(registry.QUERIES["op13_prefix_trie"](spark, sf_dir), connect(sf_dir), registry.ORACLE_SQL["op13_prefix_trie"])
