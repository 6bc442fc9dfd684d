"""The tree of shared conversation openings, built from prefix digests and first owned depths.

A node of depth d is a distinct sequence of first d turns; its owner is the smallest conversation that begins so.  Who owns a node owns all
deeper ones on its own path, so a conversation's nodes are a chain from its first owned depth to its end, and chains hang from chains.

1. Turns are numbered by a range sort of slim rows (ids and digests, no texts), which splits a long conversation over tasks.
2. The digest of a prefix is the xor of digests of (depth, turn): running xors inside a sort range, then over the ranges of a conversation.
   One aggregate gives each prefix its smallest conversation and its count.
3. Binary search of the first owned depth: a round probes the middle of every open interval in one batch of joins against these minima.
   The last probe that failed is the node above, so it also names the parent.
4. Chains are summed bottom-up by pointer jumping, in as many rounds as the nesting of chains has bits; then sums run up each chain, over blocks of depths.
5. Ids that end at a node are joined in blocks of 4,096, and the blocks of a node are hashed as a stream, never held together.

No conversation, node or group is collected in one row; hot openings are merged before each shuffle.

Defined cases: a null role or text is empty; null turn numbers come first; rows that share a turn number are ordered by the digest of role and
text, so repeated rows are turns of their own; rows without conv_id belong to no conversation and are left out; a very long text is read
once, for its digest and words; an empty table gives no rows; only the four named columns are read, whatever others are called.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm.common import WORD, bounded_batches, discard, folds, integral, parts, stored, table
from lodestone.llm.runs import CRC32_SQL

_BLOCK = 4096  # ids in a string, and depths in a block of a chain


def numbered(rows: DataFrame) -> DataFrame:
    """(conv, part, pos, print, words): turns in order from 0; part is the sort range a row fell into, and grows with pos."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    slim = rows.where("conv_id IS NOT NULL").select(
        integral(rows, "conv_id").alias("conv"),
        "turn",
        F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256).alias("print"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"),
    )
    order = ["conv", "turn", "print"]
    dealt = slim.repartitionByRange(parts(rows.sparkSession), *order).sortWithinPartitions(*order)
    dealt = stored(dealt.select("conv", "print", "words", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("seq")), "turns")
    spans = dealt.groupBy("conv", "part").agg(F.count("*").alias("n"), F.min("seq").alias("first"))
    earlier = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    return dealt.join(spans, ["conv", "part"]).select("conv", "part", (F.col("seq") - F.col("first") + F.col("before")).alias("pos"), "print", "words")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((conv, size) for each conversation, its turns (conv, part, d, print, words) from d = 1): the first h turns of conversation c - c % 20, then
    one's own turns after the first h; h = crc32(c) % 4.  As in SQL, c % 20 has the sign of c."""
    convs = turns.groupBy("conv").agg(F.count("*").alias("own"))
    convs = convs.withColumn("h", folds(F.col("conv"), 4)).withColumn("base", F.col("conv") - F.col("conv") % 20)
    lengths = convs.select(F.col("conv").alias("base"), F.col("own").alias("there"))
    convs = convs.join(lengths, "base", "left").withColumn("taken", F.least("h", F.coalesce("there", F.lit(0))))
    convs = convs.select("conv", "base", "h", "taken", (F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("size"))
    heads = turns.where("pos < 3").select(F.col("conv").alias("base"), "pos", "print", "words")
    head = convs.where("taken > 0").join(heads, "base").where("pos < taken").select("conv", F.lit(-1).alias("part"), (F.col("pos") + 1).alias("d"), "print", "words")
    own = turns.join(convs, "conv").where("pos >= h").select("conv", "part", (F.col("taken") + F.col("pos") - F.col("h") + 1).alias("d"), "print", "words")
    return convs.select("conv", "size"), head.unionByName(own)


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv, d, k1, k2, words): two digests of 60 bits of the first d turns, from turns (conv, part, d, print, words)."""
    code = F.sha2(F.concat_ws(":", F.col("d").cast("string"), "print"), 256)

    def lane(at: int) -> Column:
        return F.conv(F.substring(F.col("code"), at, 15), 16, 10).cast("long")

    salted = turns.withColumn("code", code).select("conv", "part", "d", "words", lane(1).alias("x1"), lane(16).alias("x2"))
    inside = Window.partitionBy("conv", "part").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    whole = salted.groupBy("conv", "part").agg(F.bit_xor("x1").alias("t1"), F.bit_xor("x2").alias("t2"))
    whole = whole.select("conv", "part", *(F.coalesce(F.bit_xor(f"t{k}").over(earlier), F.lit(0)).alias(f"t{k}") for k in (1, 2)))
    running = salted.select("conv", "part", "d", "words", *(F.bit_xor(f"x{k}").over(inside).alias(f"x{k}") for k in (1, 2)))
    return running.join(whole, ["conv", "part"]).select("conv", "d", *(F.col(f"x{k}").bitwiseXOR(F.col(f"t{k}")).alias(f"k{k}") for k in (1, 2)), "words")


def first_owned(convs: DataFrame, keys: DataFrame, minima: DataFrame) -> DataFrame:
    """(conv, size, first, above): the smallest depth from 1 on at which the conversation is the smallest of its prefix, size + 1 if there is none, and the owner one depth above (null at depth 0)."""
    at = stored(convs.select("conv", "size", F.lit(1).cast("long").alias("lo"), (F.col("size") + 1).alias("hi"), F.lit(None).cast("long").alias("above")), "search")
    while at.where("lo < hi").limit(1).count():
        middle = F.floor((F.col("lo") + F.col("hi")) / 2).alias("d")
        probe = at.where("lo < hi").select("*", middle).join(keys.select("conv", "d", "k1", "k2"), ["conv", "d"]).join(minima.select("d", "k1", "k2", "owner"), ["d", "k1", "k2"])
        owned = F.col("owner") == F.col("conv")
        moved = probe.select(
            "conv", "size", F.when(owned, F.col("lo")).otherwise(F.col("d") + 1).alias("lo"), F.when(owned, F.col("d")).otherwise(F.col("hi")).alias("hi"), F.when(owned, F.col("above")).otherwise(F.col("owner")).alias("above")
        )
        after = stored(moved.unionByName(at.where("lo = hi")), "search")
        discard(at)
        at = after
    return at.select("conv", "size", F.col("lo").alias("first"), "above")


def summed_up(chains: DataFrame) -> DataFrame:
    """(conv, leaves, saved) with the sums over the chain and all chains below it, from (conv, parent, leaves, saved)."""
    at = stored(chains.select("conv", F.col("parent").alias("jump"), "leaves", "saved"), "sums")
    while at.where("jump IS NOT NULL").limit(1).count():
        open_ones = at.where("jump IS NOT NULL")
        below = open_ones.groupBy(F.col("jump").alias("conv")).agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
        onward = open_ones.select(F.col("conv").alias("jump"), F.col("jump").alias("further"))
        after = at.join(below, "conv", "left").join(onward, "jump", "left")
        after = after.select("conv", F.col("further").alias("jump"), *((F.col(n) + F.coalesce(n[0], F.lit(0))).alias(n) for n in ("leaves", "saved")))
        after = stored(after, "sums")
        discard(at)
        at = after
    return at.select("conv", "leaves", "saved")


def up_the_chain(nodes: DataFrame, *names: str) -> DataFrame:
    """Each named column of nodes (conv, d, ...) summed from a node to the end of its chain."""
    nodes = nodes.withColumn("block", F.floor(F.col("d") / _BLOCK))
    inside = Window.partitionBy("conv", "block").orderBy(F.col("d").desc()).rowsBetween(Window.unboundedPreceding, 0)
    deeper = Window.partitionBy("conv").orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    whole = nodes.groupBy("conv", "block").agg(*(F.sum(n).alias(f"{n}_of_block") for n in names))
    whole = whole.select("conv", "block", *(F.coalesce(F.sum(f"{n}_of_block").over(deeper), F.lit(0)).alias(f"{n}_deeper") for n in names))
    out = nodes.withColumns({n: F.sum(n).over(inside) for n in names}).join(whole, ["conv", "block"])
    return out.withColumns({n: F.col(n) + F.col(f"{n}_deeper") for n in names}).drop("block", *(f"{n}_deeper" for n in names))


def hashed_ids(members: DataFrame) -> DataFrame:
    """(conv, d, ends_sha256): SHA-256 of the ids of each node, ascending and joined by commas, from members (conv, d, id) with distinct ids."""
    bounded_batches(members.sparkSession)
    block = members.groupBy("conv", "d", F.floor(F.col("id") / _BLOCK).alias("block")).agg(F.sort_array(F.collect_list("id")).alias("ids"))
    block = block.select("conv", "d", "block", F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("ids"))
    dealt = block.repartition(parts(members.sparkSession), "conv", "d").sortWithinPartitions("conv", "d", "block")

    def run(batches):
        key, digest = None, None
        for batch in batches:
            done = []
            for conv, d, ids in zip(*(batch.column(k).to_pylist() for k in (0, 1, 3)), strict=True):
                if (conv, d) == key:
                    digest.update(b",")
                else:
                    if key:
                        done.append((*key, digest.hexdigest()))
                    key, digest = (conv, d), hashlib.sha256()
                digest.update(ids.encode())
            yield told(done)
        if key:
            yield told([(*key, digest.hexdigest())])

    def told(done):
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in done], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.string()))], names=["conv", "d", "ends_sha256"])

    return dealt.mapInArrow(run, "conv long, d long, ends_sha256 string")


def prefix_tree(conversations: DataFrame) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) for each node over rows (conv_id, turn, role, text)."""
    turns = stored(numbered(conversations), "numbered")
    convs, again = rebuilt(turns)
    convs, keys = stored(convs, "convs"), stored(prefixes(again), "prefixes")
    minima = stored(keys.groupBy("d", "k1", "k2").agg(F.min("conv").alias("owner"), F.count("*").alias("n_convs"), F.min("words").alias("words")), "minima")
    search = first_owned(convs, keys, minima)

    top = convs.agg(F.min("conv").alias("top"), F.count("*").alias("all")).where("top IS NOT NULL")  # one row: the owner of the root
    owns = F.col("conv") == F.col("top")
    placed = search.join(F.broadcast(top), F.lit(True)).select(
        "conv",
        "size",
        F.when(owns, F.lit(0)).otherwise(F.col("first")).cast("long").alias("first"),
        F.when(~owns, F.coalesce("above", "top")).alias("parent"),
    )
    placed = stored(placed, "placed")
    chains = placed.where("first <= size")
    ends = placed.select(F.when(F.col("first") <= F.col("size"), F.col("conv")).otherwise(F.col("parent")).alias("conv"), F.col("size").alias("d"), F.col("conv").alias("id"))

    root = top.select(F.col("top").alias("conv"), F.lit(0).cast("long").alias("d"), F.col("all").alias("n_convs"), F.lit(0).cast("long").alias("words"))
    nodes = minima.select(F.col("owner").alias("conv"), "d", "n_convs", "words").unionByName(root).join(chains, "conv")
    hung = chains.where("parent IS NOT NULL").select(F.col("parent").alias("conv"), (F.col("first") - 1).alias("d"), F.col("conv").alias("below"))
    nodes = nodes.join(hung.groupBy("conv", "d").agg(F.count("*").alias("hanging")), ["conv", "d"], "left")
    n_children = F.coalesce("hanging", F.lit(0)) + F.when(F.col("d") < F.col("size"), 1).otherwise(0)
    nodes = nodes.select("conv", "d", "first", "parent", "n_convs", n_children.alias("n_children"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved"))
    nodes = stored(nodes.withColumn("leaves", F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long")), "nodes")

    totals = summed_up(nodes.groupBy("conv").agg(F.min("parent").alias("parent"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")))
    from_below = hung.join(totals.select(F.col("conv").alias("below"), F.col("leaves").alias("l"), F.col("saved").alias("s")), "below").groupBy("conv", "d").agg(F.sum("l").alias("l"), F.sum("s").alias("s"))
    whole = nodes.join(from_below, ["conv", "d"], "left").withColumns({n: F.col(n) + F.coalesce(n[0], F.lit(0)) for n in ("leaves", "saved")})
    whole = up_the_chain(whole.drop("l", "s"), "leaves", "saved").join(hashed_ids(ends), ["conv", "d"], "left")
    return whole.select(
        F.col("conv").alias("conv_id"),
        F.col("d").alias("depth"),
        F.when(F.col("d") > F.col("first"), F.col("conv")).otherwise(F.col("parent")).alias("parent_conv_id"),
        "n_convs",
        F.col("n_children").cast("long").alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_tree(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))


OP13_SQL = rf"""
WITH slim AS (
  SELECT conv_id AS conv, turn, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS print, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words
  FROM conversations WHERE conv_id IS NOT NULL
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, print) - 1 AS pos FROM slim
), convs AS (
  SELECT conv, conv - conv % 20 AS base, {CRC32_SQL.format("conv::VARCHAR")} % 4 AS h FROM (SELECT DISTINCT conv FROM slim)
), turns AS (
  SELECT c.conv, 0 AS own, pos, print, words FROM convs c JOIN numbered n ON n.conv = c.base WHERE pos < h
  UNION ALL SELECT c.conv, 1, pos, print, words FROM convs c JOIN numbered n ON n.conv = c.conv WHERE pos >= h
), rebuilt AS (
  SELECT conv, words, print, row_number() OVER (PARTITION BY conv ORDER BY own, pos) AS d FROM turns
), prefix AS (
  SELECT conv, d, words, string_agg(print, ',') OVER (PARTITION BY conv ORDER BY d) AS key FROM rebuilt
  UNION ALL SELECT conv, 0, 0, '' FROM convs
), node AS (
  SELECT key, min(conv) AS conv, max(d) AS d, count(*) AS n_convs, (count(*) - 1) * max(words) AS saved FROM prefix GROUP BY key
), ends AS (
  SELECT key, string_agg(conv::VARCHAR, ',' ORDER BY conv) AS ids FROM (SELECT * FROM prefix QUALIFY row_number() OVER (PARTITION BY conv ORDER BY d DESC) = 1) GROUP BY key
), children AS (
  SELECT up.key, count(DISTINCT down.key) AS n_children FROM prefix up JOIN prefix down ON up.conv = down.conv AND down.d = up.d + 1 GROUP BY up.key
), parents AS (
  SELECT down.key, min(node.conv) AS parent FROM prefix down JOIN prefix up ON up.conv = down.conv AND up.d = down.d - 1 JOIN node ON node.key = up.key GROUP BY down.key
), subtree AS (
  SELECT p.key, sum(n.saved) AS saved, count(*) FILTER (c.n_children IS NULL) AS leaves FROM node n LEFT JOIN children c ON c.key = n.key JOIN prefix p ON p.conv = n.conv AND p.d <= n.d GROUP BY p.key
)
SELECT conv AS conv_id, d AS depth, parent AS parent_conv_id, n_convs, coalesce(n_children, 0) AS n_children, leaves AS n_leaves, subtree.saved::BIGINT AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM node LEFT JOIN ends USING (key) LEFT JOIN children USING (key) LEFT JOIN parents USING (key) JOIN subtree USING (key)
"""
