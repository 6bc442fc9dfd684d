"""MinHash near-dedup on multisets of five-word shingles with BagMinHash signatures.

Signatures.  A shingle of multiplicity c owns the weight axis [0, c), cut into the dyadic intervals [0,1), [1,2), [2,4), [4,8) ...  Each (shingle, interval) is
a Poisson process in time whose rate is the interval's width; a point falls on one of m registers and at one of the interval's discrete weights, and counts if
that weight lies below c.  A register keeps the earliest time.  Two multisets agree in a register with a chance equal to their weighted Jaccard
similarity.  Processes are advanced together, one point a round, and stop as soon as their time passes the latest register of their document.

Bands.  m = bands x rows.  Documents with a band in common are candidates.  Every member is verified against the leader of its band by exact multiset
overlap; after that, only members of different components still meet (see classes_of), so a group of copies costs a link a member and not all its pairs.
Exact copies (md5 of the text) are one node from the start.  Verified links are closed to classes by label propagation with pointer jumping over tables in the shared folder;
a class is named by its smallest doc_id.

Defined cases: texts of 1 to 4 words are one shingle of all their words; null and empty texts have no shingles and form links with exact copies only
(a null text is the empty text); rows that repeat a doc_id are members like any other, and a doc_id shared by unlike texts is a class name only; rows without id join classes by
their text, and a class without any id has a null name; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm import textkit as tk
from lodestone.llm.common import annotate, discard, shared_dir, stored, table, tidy

SHINGLE = 5
_Q = tk.U(0x9E3779B97F4A7C15)
_S = tk.U(0xD6E8FEB86659FD93)


def shingles(block: tk.Block, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of every shingle, repeats included."""
    found = tk.words(block)
    keys, at = tk.windows(found.hashes, found.first, k)
    doc = found.doc[at]
    short = np.flatnonzero((found.counts > 0) & (found.counts < k))
    if len(short):
        extra = [found.hashes[found.first[d] : found.first[d + 1]] for d in short]
        with np.errstate(over="ignore"):
            hashes = np.array([np.bitwise_xor.reduce(tk.mix(w * (np.arange(len(w), dtype=tk.U) * _S + _Q))) for w in extra], tk.U)
        keys, doc = np.concatenate([keys, hashes]), np.concatenate([doc, short])
    return doc, keys


def multisets(block: tk.Block, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, shingle, multiplicity), in order of documents."""
    doc, keys = shingles(block, k)
    order = np.lexsort((keys, doc))
    doc, keys = doc[order], keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    return doc[at], keys[at], np.diff(np.append(at, len(keys)))


def bagminhash(doc: np.ndarray, keys: np.ndarray, counts: np.ndarray, n: int, m: int) -> np.ndarray:
    """n x m registers (float32 times); rows of documents without shingles are infinite."""
    top = np.ceil(np.log2(counts)).astype(np.int64)  # intervals 0 .. top cover [0, counts)
    each = np.repeat(np.arange(len(keys)), top + 1)
    level = np.arange(len(each)) - np.repeat(np.cumsum(top + 1) - (top + 1), top + 1)
    low = np.where(level > 0, 1 << np.maximum(level - 1, 0), 0)
    width = np.maximum(low, 1)
    seed = tk.mix(keys[each] + level.astype(tk.U) * _Q)
    limit = counts[each] - low  # weights of the interval below this count
    owner, time = doc[each], np.zeros(len(each))
    registers = np.full(n * m, np.inf)
    step = 0
    while len(seed):
        step += 1
        draw = tk.mix(seed + tk.U(step * int(_S) % 2**64))
        time = time - np.log(((draw >> tk.U(11)).astype(np.float64) + 0.5) * 2.0**-53) / width
        second = tk.mix(draw ^ _Q)
        slot = ((second >> tk.U(32)) * tk.U(m) >> tk.U(32)).astype(np.int64)
        weight = ((second & tk.U(0xFFFFFFFF)) * width.astype(tk.U) >> tk.U(32)).astype(np.int64)
        counts_in = weight < limit
        np.minimum.at(registers, (owner * m + slot)[counts_in], time[counts_in])
        latest = registers.reshape(n, m).max(axis=1)
        on = np.flatnonzero(time < latest[owner])
        seed, time, width, limit, owner = seed[on], time[on], width[on], limit[on], owner[on]
    return registers.reshape(n, m).astype(np.float32)


def band_keys(registers: np.ndarray, bands: int) -> np.ndarray:
    """n x bands keys; the number of the band is part of the key."""
    bits = registers.view(np.uint32).astype(tk.U).reshape(len(registers), bands, -1)
    out = np.broadcast_to(np.arange(bands, dtype=tk.U) * _S, bits.shape[:2]).copy()
    for j in range(bits.shape[2]):
        out = tk.mix(out * _Q + bits[:, :, j])
    return out.view(np.int64)


def signatures(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    """(doc_id, print, bands): no bands for texts without words."""

    def scan(column: pa.Array, row: pa.StructArray) -> list[pa.Array]:
        out = []
        for block in tk.blocks(column, 1 << 20):
            doc, keys, counts = multisets(block)
            made = band_keys(bagminhash(doc, keys, counts, block.n, bands * rows), bands)
            full = np.bincount(doc, minlength=block.n) > 0
            sizes = np.where(full, bands, 0)
            out.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(made[full].reshape(-1))))
        return [pa.concat_arrays(out) if out else pa.array([], pa.list_(pa.int64()))]

    rows_of = docs.select("doc_id", printed().alias("print"), F.coalesce("text", F.lit("")).alias("text"))
    return annotate(rows_of, scan, "bands array<long>", keep=("doc_id", "print")).select("row.doc_id", "row.print", "bands")


def printed() -> Column:
    return F.unhex(F.md5(F.coalesce("text", F.lit(""))))


def multiset_blobs(texts: DataFrame) -> DataFrame:
    """(print, blob): sorted 64-bit hashes of (shingle, occurrence), so that set overlap is multiset overlap."""

    def scan(column: pa.Array, row: pa.StructArray) -> list[pa.Array]:
        out = []
        for block in tk.blocks(column):
            doc, keys, counts = multisets(block)
            each = np.repeat(np.arange(len(keys)), counts)
            nth = np.arange(len(each)) - np.repeat(np.cumsum(counts) - counts, counts)
            hashed = tk.mix(keys[each] + nth.astype(tk.U) * _S)
            owner = doc[each]
            order = np.lexsort((hashed, owner))
            out += [x.tobytes() for x in np.split(hashed[order], np.searchsorted(owner[order], np.arange(1, block.n)))]
        return [pa.array(out, pa.binary())]

    return annotate(texts, scan, "blob binary", keep=("print",)).select("row.print", "blob")


def shared_of(a: bytes, b: bytes) -> tuple[np.ndarray, int, np.ndarray]:
    """The elements of a, the size of b, and which elements of a are in b."""
    x, y = np.frombuffer(a, tk.U), np.frombuffer(b, tk.U)
    if not len(y):
        return x, 0, np.zeros(len(x), bool)
    return x, len(y), y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x


_VERIFIED = "a binary, b binary, sim double, size_a int, common int, outside array<long>"


def verify(edges: DataFrame, blobs: DataFrame) -> DataFrame:
    """For edges (a, b): the exact multiset overlap, and the elements of a outside b."""
    left = blobs.select(F.col("print").alias("a"), F.col("blob").alias("blob_a"))
    right = blobs.select(F.col("print").alias("b"), F.col("blob").alias("blob_b"))
    names = [x.split()[0] for x in _VERIFIED.split(", ")]

    def run(batches):
        for batch in batches:
            sim, size, common, outside = [], [], [], []
            for a, b in zip(batch.column(2), batch.column(3), strict=True):
                x, n, inside = shared_of(a.as_buffer(), b.as_buffer())
                both = int(inside.sum())
                sim.append(both / max(1, len(x) + n - both))
                size.append(len(x))
                common.append(both)
                outside.append(x[~inside].view(np.int64))
            made = [pa.array(sim, pa.float64()), pa.array(size, pa.int32()), pa.array(common, pa.int32()), pa.array(outside, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], names=names)
        tidy()

    return edges.join(left, "a").join(right, "b").select("a", "b", "blob_a", "blob_b").mapInArrow(run, _VERIFIED)


def labelled(members: DataFrame, labels: DataFrame) -> DataFrame:
    """members with the label of their component; a node without links is its own."""
    return members.join(labels.select(F.col("node").alias("print"), "label"), "print", "left").withColumn("label", F.coalesce("label", "print"))


def classes_of(members: DataFrame, blobs: DataFrame, least: float, at_once: int = 128, salts: int = 8) -> DataFrame:
    """(node, label) of the components of all links inside the bands of members (band, print), without making all pairs of a band.

    1. Every member meets the leader of its band: the member whose bands are fullest, which in a group of copies is the one the others derive from.
    2. Two members x, y in different components then share few elements through their leader.  A link needs |x & y| >= least / (1 + least) * (|x| + |y|), and the leader's part of that is at
       most |x & leader|; the rest must be elements both have outside the leader.  So members with a common outside element meet: first each of them the one closest to
       the leader, then, for what is still apart, by common outside elements from the rarest on, as far as the bound leaves open (prefix and position filter).
    3. Pairs whose bound asks for no outside element (both lie inside a longer leader) are left: members that can be in one meet the members of other components in rounds of
       `at_once` a band, less the pairs that the bound or the triangle inequality of the Jaccard distance rules out.
    """
    # What a large band or a common leader is joined with is a stored table, so that its rows can be split among tasks.
    sizes = stored(members.groupBy("band").agg(F.count("*").alias("n")), "band-sizes")
    weight = stored(members.join(sizes, "band").groupBy("print").agg(F.sum("n").alias("w")), "weights")
    leaders = stored(members.join(weight, "print").groupBy("band").agg(F.max(F.struct("w", "print"))["print"].alias("b")), "leaders")
    led = stored(members.join(leaders, "band"), "led")
    discard(sizes, weight, leaders)
    checked = stored(verify(led.where("print <> b").select(F.col("print").alias("a"), "b").distinct(), blobs), "verified")
    edges = checked.where(F.col("sim") >= least).select("a", "b")
    labels = components(edges)

    outside = checked.select("a", "b", "sim", "size_a", "common", F.explode("outside").alias("token"))
    closest = outside.groupBy("b", "token").agg(F.max(F.struct("sim", "a"))["a"].alias("c"), F.count("*").alias("df")).where("df > 1")
    closest = stored(closest, "closest")
    meets = outside.join(closest, ["b", "token"]).where("a <> c").select("a", "c").distinct()
    apart = _apart(meets.select("a", F.col("c").alias("b")), labels)
    found = stored(verify(apart, blobs).where(F.col("sim") >= least).select("a", "b"), "links")
    edges = edges.unionByName(found)
    labels = components(edges)

    # Elements outside the leader, rarest first in one order for all; with i and j places left behind a common element, a pair shares at most 1 + min(i, j) of them.
    counted = outside.join(closest.select("b", "token", "df"), ["b", "token"])  # shared ones; the others come first and only take up places
    place = F.row_number().over(Window.partitionBy("a", "b").orderBy(F.col("df").desc(), F.col("token").desc()))
    # A partner holds at least `least` of x's size, so x alone needs least * size_a - common elements outside the leader: the commonest elements go before the join, not after it.
    rare = counted.withColumn("left", place - 1).where(F.col("left") + 1 >= F.ceil(least * F.col("size_a") - 1e-9) - F.col("common"))
    left = labelled(rare.withColumnRenamed("a", "print"), labels).withColumnRenamed("print", "a")
    x, y = _not_with_leader(left, labels).alias("x"), left.alias("y")
    needs = F.greatest(F.lit(1), F.ceil(least / (1 + least) * (F.col("x.size_a") + F.col("y.size_a")) - 1e-9) - F.least("x.common", "y.common"))
    possible = (F.col("x.label") != F.col("y.label")) & (F.least("x.left", "y.left") + 1 >= needs)
    possible = possible & _may_link(*(F.col(f"{side}.{c}") for side in "xy" for c in ("sim", "size_a", "common")), least)
    meets = x.join(y, (F.col("x.b") == F.col("y.b")) & (F.col("x.token") == F.col("y.token")) & possible)
    meets = meets.select(F.least("x.a", "y.a").alias("a"), F.greatest("x.a", "y.a").alias("b")).distinct()
    found = stored(verify(meets, blobs).where(F.col("sim") >= least).select("a", "b"), "links")
    if not found.isEmpty():
        edges = edges.unionByName(found)
        labels = components(edges)
    discard(closest)

    # The smallest size a partner of x can have: one of the sizes there are (a set of numbers, not of members) that is at least `least` of x's.
    lengths = stored(checked.groupBy("b").agg(F.collect_set("size_a").alias("sizes")), "sizes")
    bounded = checked.join(lengths, "b")
    floor = F.ceil(least * F.col("size_a") - 1e-9)
    other = F.coalesce(F.array_min(F.filter("sizes", lambda n: n >= floor)), floor)
    needs = F.ceil(least / (1 + least) * (F.col("size_a") + other) - 1e-9) - F.col("common")
    inner = bounded.where(needs <= 0).select(F.col("a").alias("print"), "b", F.lit(True).alias("inner"))
    met = led.join(checked.select(F.col("a").alias("print"), "b", "sim", "size_a", "common"), ["print", "b"], "left").join(inner, ["print", "b"], "left")
    placed = stored(met.select("band", "print", "b", F.coalesce("sim", F.lit(1.0)).alias("sim"), "size_a", "common", F.coalesce("inner", F.lit(False)).alias("inner")), "placed")
    discard(lengths, led)
    done = None
    while True:
        tagged = labelled(placed, labels)
        open_members = _not_with_leader(placed.where("inner").withColumnRenamed("print", "a"), labels).withColumnRenamed("a", "print")
        if done is not None:
            open_members = open_members.join(done, ["band", "print"], "left_anti")
        # Each of `salts` parts of a band gives its share, so no task sees a whole band; whatever is left over comes in a later round.
        part = Window.partitionBy("band", F.pmod(F.xxhash64("print"), F.lit(salts))).orderBy("print")
        chosen = open_members.withColumn("n", F.row_number().over(part)).where(F.col("n") <= max(1, at_once // salts))
        chosen = stored(labelled(chosen.select("band", "print", "sim", "size_a", "common"), labels), "inner")
        if chosen.isEmpty():
            return labels
        lists = stored(chosen.groupBy("band").agg(F.collect_list(F.struct("print", "label", "sim", "size_a", "common")).alias("others")), "lists")  # at most at_once a band

        def possible(o: Column) -> Column:
            """Another component, within the triangle inequality, and what both share with the leader may do by itself; all other pairs met by an outside element, and
            the leader itself was met first."""
            enough = F.least(o["common"], F.col("common")) >= least / (1 + least) * (o["size_a"] + F.col("size_a")) - 1e-9
            return (o["label"] != F.col("label")) & enough & _may_link(o["sim"], o["size_a"], o["common"], F.col("sim"), F.col("size_a"), F.col("common"), least)

        pairs = tagged.join(lists, "band").select("print", F.explode(F.transform(F.filter("others", possible), lambda o: o["print"])).alias("other"))
        pairs = pairs.select(F.least("print", "other").alias("a"), F.greatest("print", "other").alias("b")).distinct()
        found = stored(verify(pairs, blobs).where(F.col("sim") >= least).select("a", "b"), "links")
        discard(lists)
        own = chosen.select("band", "print")
        done = own if done is None else done.unionByName(own)
        if not found.isEmpty():
            edges = edges.unionByName(found)
            labels = components(edges)


def _may_link(sim_x: Column, size_x: Column, common_x: Column, sim_y: Column, size_y: Column, common_y: Column, least: float) -> Column:
    """What two members' overlaps with one leader leave possible: the triangle inequality, the sizes, and elements enough inside and outside the leader."""
    most = F.least(common_x, common_y) + F.least(size_x - common_x, size_y - common_y)
    enough = most >= least / (1 + least) * (size_x + size_y) - 1e-9
    return (F.abs(sim_x - sim_y) <= 1 - least + 1e-9) & enough


def _apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs (a, b) whose components differ."""
    of = lambda name, out: labels.select(F.col("node").alias(name), F.col("label").alias(out))
    joined = pairs.join(of("a", "label_a"), "a", "left").join(of("b", "label_b"), "b", "left")
    return joined.where(F.coalesce("label_a", "a") != F.coalesce("label_b", "b")).select("a", "b")


def _not_with_leader(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """rows (a, b, ...) whose a is not in the component of its leader b."""
    of = lambda name, out: labels.select(F.col("node").alias(name), F.col("label").alias(out))
    joined = rows.join(of("a", "label_a"), "a", "left").join(of("b", "label_b"), "b", "left")
    return joined.where(F.coalesce("label_a", "a") != F.coalesce("label_b", "b")).drop("label_a", "label_b")


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node of each component of the edges (a, b)."""
    both = stored(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("label")), "labels")
    while True:
        beside = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("next"))
        moved = labels.join(beside, labels["node"] == beside["a"]).select("node", "label", F.least("label", "next").alias("next"))
        jump = labels.select(F.col("node").alias("next"), F.col("label").alias("far"))
        moved = stored(moved.join(jump, "next").select("node", F.least("next", "far").alias("label"), (F.least("next", "far") != F.col("label")).alias("changed")), "labels")
        discard(labels)
        if moved.where("changed").isEmpty():
            discard(both)
            return moved.select("node", "label")
        labels = moved


def near_duplicates(docs: DataFrame, least: float = 0.8, bands: int = 24, rows: int = 4) -> DataFrame:
    """(doc_id, print, class_id, label), a row for each row of docs; label (the smallest print) tells classes apart also where names are null or alike."""
    shared_dir(docs.sparkSession)
    signed = stored(signatures(docs.select("doc_id", "text"), bands, rows), "signatures")
    nodes = stored(signed.groupBy("print").agg(F.min("doc_id").alias("doc_id"), F.any_value("bands").alias("bands")), "nodes")
    members = nodes.select("print", F.explode("bands").alias("band"))
    shared = members.groupBy("band").agg(F.min("print").alias("first"), F.max("print").alias("last")).where("first <> last").select("band")
    members = stored(members.join(shared, "band", "left_semi"), "band-members")

    wanted = members.select("print").distinct().join(nodes.select("print", "doc_id"), "print")
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), printed().alias("print"))
    chosen = texts.join(wanted.select(F.col("print").alias("p"), F.col("doc_id").alias("d")), (F.col("print") == F.col("p")) & F.col("doc_id").eqNullSafe(F.col("d")), "left_semi")
    blobs = stored(multiset_blobs(chosen).groupBy("print").agg(F.any_value("blob").alias("blob")), "multisets")

    labels = classes_of(members, blobs, least)
    discard(members, blobs)
    named = nodes.select("print", "doc_id").join(labels.withColumnRenamed("node", "print"), "print", "left").withColumn("label", F.coalesce("label", "print"))
    classes = named.groupBy("label").agg(F.min("doc_id").alias("class_id"))
    names = stored(classes, "class-names")
    by_print = stored(named.join(names, "label").select("print", "class_id", "label"), "classes")
    discard(nodes, names)
    return signed.select("doc_id", "print").join(by_print, "print").select("doc_id", "print", "class_id", "label")


def keep_first(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """One row of docs for each class: of the smallest doc_id (null only where no member has one), then of the smallest print; of rows that repeat it, any one."""
    least = F.min(F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "print"))
    first = stored(classes.groupBy("label").agg(least.alias("f")).select(F.col("f.doc_id").alias("id"), F.col("f.print").alias("first")), "firsts")
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id").alias("own"), printed().alias("print"))
    kept = packed.join(first, F.col("own").eqNullSafe(F.col("id")) & (F.col("print") == F.col("first")), "left_semi")
    return kept.dropDuplicates(["own", "print"]).select("row.*")


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id")
