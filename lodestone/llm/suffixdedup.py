"""Suffix-array dedup: bytes covered by a `length`-byte string that also starts in a document with a smaller doc_id.

Longest-previous-factor arrays need the suffixes that could match side by side, not all suffixes of the corpus in one place.

1. Anchors.  Every window of `length` bytes holds the smallest hash among its `gram`-byte substrings, so equal strings hold equal anchors at equal offsets.
   Documents are packed into compressed chunks with their anchor positions, a table in the shared folder.
2. Shared anchors.  Chunks send each anchor hash once a bucket, with a count; buckets answer for each hash whether two documents hold it, and whether it is hot.
3. Contexts.  For shared anchors a chunk sends each distinct context (all bytes a window around the anchor can reach) once, with the smallest doc_id that has it.  A hot anchor's
   contexts are dealt out further: its window starts fall into `pieces` ranges, and a range goes to a bucket by the longer string that all its windows hold, cut to the bytes they reach.
4. Longest previous factors.  A bucket puts the suffixes of its contexts in order: those from the anchor on by their bytes, and those from each byte further left by one stable radix
   pass over the order before.  Neighbours give the common prefixes; the nearest suffixes before and behind in that order with a smaller doc_id (previous and next smaller values) give
   the longest previous factor of each suffix, up to the end of its context.  Bytes [s, s + factor) go where the factor reaches `length`.
5. Removal.  As the factor shrinks by at most one a byte, those ranges are the union of the windows whose start has a factor of `length` or more: answers are one word of bits a
   context.  The chunk marks windows, merges them to spans and cuts.

All keys that many documents share are merged inside a chunk before they are sent.  Hashes only choose what is compared: contexts are merged, and windows removed, after their bytes agreed.
Buckets are as many as the anchors ask for, so that one holds about `bucket_anchors` at any size of the input.

Defined cases: a null text is empty; texts shorter than `length` lose nothing; rows with equal doc_id never remove bytes of each other; rows without id rank with the largest long, after all
others, and do not remove each other's bytes; an id that is no whole number is an error; a text longer than a chunk is a chunk of its own; cuts may fall inside a character, so kept text is binary;
an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import textkit as tk
from lodestone.llm.common import integral, shared_dir, stored, table, tidy

_NO_ID = np.iinfo(np.int64).max
_CHUNK = "uid long, text binary, sizes binary, ids binary, missing binary, anchors binary, n_anchors long"
_NOTE = "uid long, bucket int, kind int, data binary"


@dataclass(frozen=True)
class Shape:
    length: int = 50
    gram: int = 24
    pieces: int = 4

    @property
    def reach(self) -> int:
        return self.length - self.gram

    @property
    def width(self) -> int:
        return 2 * self.length - self.gram

    @property
    def starts(self) -> int:
        return self.reach + 1

    @property
    def ranges(self) -> list[tuple[int, int]]:
        """The first and last window start of each piece of a hot anchor's contexts."""
        cuts = np.linspace(0, self.starts, self.pieces + 1).astype(int)
        return [(int(a), int(b) - 1) for a, b in zip(cuts[:-1], cuts[1:], strict=True) if b > a]


def pack(data: bytes | np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(data).tobytes() if isinstance(data, np.ndarray) else data)


def unpack(column, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(column.as_buffer()), kind)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    have = 1
    while 2 * have <= w:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (w - have)], x[w - have :]) if have < w else x


_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE_CODE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n + 1 powers of the rolling hash's base and of its inverse, modulo 2**64."""
    if len(_powers.get("up", ())) <= n:
        size = max(1 << 20, (n + 1) * 9 // 8)
        for key, base in (("up", _BASE), ("down", _BASE_INVERSE)):
            steps = np.full(size, base, tk.U)
            steps[0] = 1
            _powers[key] = np.cumprod(steps, dtype=tk.U)
    return _powers["up"], _powers["down"]


def gram_hashes(data: np.ndarray, at: np.ndarray | None, gram: int) -> np.ndarray:
    """Rolling hashes; they only choose anchors, so a collision costs a comparison and changes nothing."""
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, tk.U)
    np.cumsum(_BYTE_CODE[data] * up[: len(data)], out=sums[1:])
    if at is None:
        return tk.mix((sums[gram:] - sums[:-gram]) * down[: len(data) - gram + 1])
    return tk.mix((sums[at + gram] - sums[at]) * down[at])


def anchors(block: tk.Block, shape: Shape) -> np.ndarray:
    """Positions of the smallest hashes of all windows inside one document; ties are all taken."""
    n, w = len(block.data), shape.starts
    if n < shape.length:
        return np.zeros(0, np.int64)
    hashes = gram_hashes(block.data, None, shape.gram)
    cuts = np.unique(block.offsets[1:-1])
    steps = np.zeros(n + 1, np.int32)  # windows that start within length - 1 before a border cross it
    np.add.at(steps, np.maximum(cuts - (shape.length - 1), 0), 1)
    np.add.at(steps, cuts, -1)
    inside = np.cumsum(steps)[: n - shape.length + 1] == 0
    pad = np.zeros(w - 1, tk.U)
    least = np.concatenate([pad, np.where(inside, sliding_min(hashes, w), tk.U(0)), pad])
    return np.flatnonzero(hashes == ~sliding_min(~least, w))


class Chunk:
    """Documents, anchors and, by bucket, the distinct anchor hashes; built alike wherever it is needed."""

    def __init__(self, text, sizes, ids, at, shape: Shape, buckets: int):
        self.shape, self.buckets = shape, buckets
        self.block = tk.Block(0, text, np.concatenate([[0], np.cumsum(sizes)]))
        self.ids, self.at = ids, at
        hashes = gram_hashes(text, at, shape.gram) if len(at) else np.zeros(0, tk.U)
        self.doc = np.searchsorted(self.block.offsets, at, "right") - 1
        bucket = ((hashes >> tk.U(32)) * tk.U(buckets) >> tk.U(32)).astype(np.int64)
        key = bucket.astype(tk.U) << tk.U(32) | (hashes & tk.U(0xFFFFFFFF))
        self.keys, self.which = np.unique(key, return_inverse=True)
        self.cuts = np.searchsorted(self.keys, np.arange(buckets + 1, dtype=tk.U) << tk.U(32))

    @classmethod
    def read(cls, row: dict, shape: Shape, buckets: int) -> Chunk:
        text, sizes, ids = unpack(row["text"], np.uint8), unpack(row["sizes"], np.int64), unpack(row["ids"], np.int64)
        return cls(text, sizes, ids, np.cumsum(unpack(row["anchors"], np.int32), dtype=np.int64), shape, buckets)

    def counts(self) -> np.ndarray:
        """How often the chunk holds each distinct hash, as the power of two that is not below it."""
        return np.ceil(np.log2(np.bincount(self.which, minlength=len(self.keys)))).astype(np.int64)

    def spread(self) -> np.ndarray:
        """For each distinct hash, whether several documents of the chunk hold it."""
        low, high = np.full(len(self.keys), len(self.ids)), np.full(len(self.keys), -1)
        np.minimum.at(low, self.which, self.doc)
        np.maximum.at(high, self.which, self.doc)
        return low != high

    def contexts(self, flags: np.ndarray) -> Contexts:
        """flags: for each distinct hash 0, 1 (shared) or 3 (shared and hot)."""
        own = flags[self.which]
        return Contexts(self, np.flatnonzero(own & 1), own[own & 1 > 0] > 1)


class Contexts:
    """The distinct contexts of the chunk's shared anchors, in order of bucket.  A hot anchor's occurrence has one for each range of window starts."""

    def __init__(self, chunk: Chunk, chosen: np.ndarray, hot: np.ndarray):
        shape, offsets = chunk.shape, chunk.block.offsets
        at, doc = chunk.at[chosen], chunk.doc[chosen]
        left = np.minimum(at - offsets[doc], shape.reach)
        right = np.minimum(offsets[doc + 1] - at - shape.gram, shape.reach)
        bucket = (chunk.keys[chunk.which[chosen]] >> tk.U(32)).astype(np.int64)
        several = np.flatnonzero(hot)
        pick, lefts, rights, buckets = [np.flatnonzero(~hot)], [left[~hot]], [right[~hot]], [bucket[~hot]]
        for number, (low, high) in enumerate(shape.ranges if len(several) else []):
            a, b = np.minimum(left[several], shape.reach - low), np.minimum(right[several], high)
            full = a + b >= shape.reach  # a window fits
            pick.append(several[full])
            lefts.append(a[full])
            rights.append(b[full])
            key = tk.span_hash(chunk.block.data, at[several[full]] - shape.reach + high, at[several[full]] - shape.reach + low + shape.length)
            key = tk.mix(key + tk.U(number))
            buckets.append(((key >> tk.U(32)) * tk.U(chunk.buckets) >> tk.U(32)).astype(np.int64))
        pick, left, right, bucket = np.concatenate(pick), np.concatenate(lefts), np.concatenate(rights), np.concatenate(buckets)
        self.at, self.doc, self.left, self.right = at[pick], doc[pick], left, right
        rows = np.zeros((len(pick), shape.width + 2), np.uint8)
        step = 1 << 16
        padded = np.concatenate([np.zeros(shape.reach, np.uint8), chunk.block.data, np.zeros(shape.reach, np.uint8)])
        column = np.arange(shape.width)
        for a in range(0, len(pick), step):
            b = slice(a, a + step)
            part = padded[self.at[b, None] + column]
            part[(column < shape.reach - left[b, None]) | (column >= shape.reach + shape.gram + right[b, None])] = 0
            rows[b, : shape.width] = part
        rows[:, shape.width], rows[:, shape.width + 1] = left, right
        firsts, self.of = distinct_rows(rows, bucket)
        self.rows, self.bucket = rows[firsts], bucket[firsts]
        self.least = np.full(len(firsts), _NO_ID)
        np.minimum.at(self.least, self.of, chunk.ids[self.doc])
        self.cuts = np.searchsorted(self.bucket, np.arange(chunk.buckets + 1))


def distinct_rows(rows: np.ndarray, group: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The first of each run of equal rows in order of (group, digest), and the run of each row.  A run ends where bytes differ, so rows of unequal bytes
    never share one; equal rows share one unless a third row has their digest."""
    digest = row_hashes(rows)
    order = np.argsort(digest, kind="stable") if group is None else np.lexsort((digest, group))
    new = np.ones(len(order), bool)
    step = 1 << 16
    for a in range(1, len(order), step):
        x, y = order[a : a + step], order[a - 1 : a - 1 + step][: len(order[a : a + step])]
        new[a : a + step] = (rows[x] != rows[y]).any(1)
    if group is not None and len(order):
        new[1:] |= group[order[1:]] != group[order[:-1]]
    of = np.empty(len(order), np.int64)
    of[order] = np.cumsum(new) - 1
    return order[new], of


def row_hashes(rows: np.ndarray) -> np.ndarray:
    wide = np.zeros((len(rows), -(-rows.shape[1] // 8) * 8), np.uint8)
    wide[:, : rows.shape[1]] = rows
    words = wide.view(tk.U)
    out = np.zeros(len(rows), tk.U)
    for j in range(words.shape[1]):
        out = tk.mix(out * tk.U(0x9E3779B97F4A7C15) + words[:, j])
    return out


def nearest_smaller(values: np.ndarray, common: np.ndarray, least: int) -> np.ndarray:
    """common[i] is the common prefix of suffixes i - 1 and i.  Returns the common prefix of each with the nearest earlier suffix of a smaller value, or 0
    where it falls below `least`: all links jump at once over what they have already passed."""
    n = len(values)
    link, shared = np.arange(n) - 1, common.copy()
    todo = np.flatnonzero((link >= 0) & (shared >= least))
    result = np.zeros(n, np.int64)
    while len(todo):
        ahead = link[todo]
        done = values[ahead] < values[todo]
        result[todo[done]] = shared[todo[done]]
        todo, ahead = todo[~done], ahead[~done]
        passed, further = np.minimum(shared[todo], shared[ahead]), link[ahead]
        link[todo], shared[todo] = further, passed
        todo = todo[(further >= 0) & (passed >= least)]
    return result


def longest_previous_factors(rows: np.ndarray, ids: np.ndarray, shape: Shape) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each byte s from the anchor back to the start of a context: the contexts whose window s is whole, in the order of their suffixes from s on, and the longest prefix that each
    of these suffixes shares with one of a smaller id, where that reaches shape.length (else 0)."""
    reach, text = shape.reach, rows[:, : shape.width]
    left, right = rows[:, shape.width].astype(np.int64), rows[:, shape.width + 1].astype(np.int64)
    end = reach + shape.gram + right
    tail = np.zeros((len(rows), -(-(shape.width - reach) // 8) * 8), np.uint8)
    tail[:, : shape.width - reach] = text[:, reach:]
    words = tail.view(">u8").astype(tk.U)
    # Behind its end a context is zero, the smallest byte, and of equal bytes the one that ends first comes first: the order of the suffixes themselves.
    order = np.lexsort((end, *words.T[::-1]))
    for s in range(reach, -1, -1):
        if s < reach:
            order = order[left[order] >= reach - s]
            order = order[np.argsort(text[order, s], kind="stable")]
        own = order[right[order] >= s]
        suffix = text[own, s:]
        differs = suffix[1:] != suffix[:-1]
        common = np.zeros(len(own), np.int64)
        if len(own) > 1:
            first = np.where(differs.any(1), differs.argmax(1), shape.width - s)
            common[1:] = np.minimum(first, np.minimum(end[own[1:]], end[own[:-1]]) - s)
        before = nearest_smaller(ids[own], common, shape.length)
        behind = nearest_smaller(ids[own][::-1], np.concatenate([[0], common[:0:-1]]), shape.length)[::-1]
        yield s, own, np.maximum(before, behind)


def resolve(rows: np.ndarray, least: np.ndarray, shape: Shape, at_once: int = 1 << 16) -> np.ndarray:
    """A word of bits for each context: bit s is set if its window s starts in a document with an id smaller than `least`."""
    starts = np.arange(shape.starts)
    all_bits = np.zeros(len(rows), np.uint32)
    for s in starts:
        all_bits |= ((s >= shape.reach - rows[:, shape.width].astype(int)) & (s <= rows[:, shape.width + 1])).astype(np.uint32) << np.uint32(s)
    firsts, of = distinct_rows(rows)
    smallest = np.full(len(firsts), _NO_ID)
    np.minimum.at(smallest, of, least)
    anchor = row_hashes(np.ascontiguousarray(rows[firsts, shape.reach : shape.reach + shape.gram]))
    _, group, size = np.unique(anchor, return_inverse=True, return_counts=True)
    several = np.flatnonzero(size[group] > 1)
    several = several[np.argsort(group[several], kind="stable")]
    bits = np.zeros(len(firsts), np.uint32)
    # Suffixes of unlike anchors share no window, so the order may be made for some anchors at a time.
    cuts, ends = [0], np.flatnonzero(np.diff(group[several], append=-1)) + 1
    while cuts[-1] < len(several):
        cuts.append(int(ends[max(np.searchsorted(ends, cuts[-1] + at_once, "right") - 1, np.searchsorted(ends, cuts[-1], "right"))]))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        part = several[a:b]
        for s, own, factor in longest_previous_factors(rows[firsts[part]], smallest[part], shape):
            bits[part[own[factor >= shape.length]]] |= np.uint32(1 << s)
    return np.where(least > smallest[of], all_bits, bits[of])


def notes(uid: int, kind: int, full: np.ndarray, blobs: list[bytes]) -> pa.RecordBatch:
    n = len(full)
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, uid)), pa.array(full.astype(np.int32)), pa.array(np.full(n, kind, np.int32)), pa.array(blobs, pa.binary())], names=["uid", "bucket", "kind", "data"])


def chunk_rows(docs: DataFrame, shape: Shape, chunk_bytes: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            ids = batch.column(0).fill_null(_NO_ID).to_numpy(zero_copy_only=False)
            missing = batch.column(0).is_null().to_numpy(zero_copy_only=False)
            for block in tk.blocks(batch.column(1), chunk_bytes):
                at = anchors(block, shape)
                own = slice(block.first, block.first + block.n)
                made = [pack(block.data), pack(np.diff(block.offsets)), pack(ids[own]), pack(missing[own]), pack(np.diff(at, prepend=0).astype(np.int32))]
                names = [x.split()[0] for x in _CHUNK.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().int >> 65]), *(pa.array([x], pa.binary()) for x in made), pa.array([len(at)])], names=names)
            tidy()

    return docs.select(integral(docs, "doc_id"), "text").mapInArrow(run, _CHUNK)


def shared_anchors(chunks: DataFrame, shape: Shape, buckets: int, hot: int) -> DataFrame:
    """Notes of kind 0: a byte for each distinct hash of a chunk and bucket: 1 if two documents hold it, 2 more if it stands `hot` times or more."""

    def send(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(j)[i] for j, name in enumerate(batch.schema.names)}
                chunk = Chunk.read(row, shape, buckets)
                marks, full = (chunk.counts() + 128 * chunk.spread()).astype(np.uint8), np.flatnonzero(np.diff(chunk.cuts))
                blobs = []
                for b in full:
                    own = slice(chunk.cuts[b], chunk.cuts[b + 1])
                    blobs.append(chunk.keys[own].astype(np.uint32).tobytes() + marks[own].tobytes())
                yield notes(row["uid"].as_py(), 0, full, blobs)

    def meet(key, group):
        hashes, marks = [], []
        for data in group["data"]:
            raw = np.frombuffer(data.as_buffer(), np.uint8)
            n = len(raw) // 5
            hashes.append(raw[: 4 * n].view(np.uint32))
            marks.append(raw[4 * n :])
        _, of = np.unique(np.concatenate(hashes), return_inverse=True)
        mark = np.concatenate(marks)
        shared = np.bincount(of, 1 + (mark > 127)) >= 2
        flags = (shared * (1 + 2 * (np.bincount(of, np.exp2(mark & 127)) >= hot)))[of].astype(np.uint8)
        answers = [f.tobytes() for f in np.split(flags, np.cumsum([len(h) for h in hashes])[:-1])]
        n = len(answers)
        return pa.table({"uid": group["uid"], "bucket": pa.array(np.full(n, key[0].as_py(), np.int32)), "kind": pa.array(np.zeros(n, np.int32)), "data": pa.array(answers, pa.binary())})

    return chunks.mapInArrow(send, _NOTE).groupBy("bucket").applyInArrow(meet, _NOTE)


def _flags(chunk: Chunk, table: pa.Table, kind: int) -> np.ndarray:
    out = np.zeros(len(chunk.keys), np.uint8)
    for bucket, k, data in zip(table["bucket"].to_pylist(), table["kind"].to_pylist(), table["data"], strict=True):
        if k == kind:
            out[chunk.cuts[bucket] : chunk.cuts[bucket + 1]] = np.frombuffer(data.as_buffer(), np.uint8)
    return out


def _row(table: pa.Table) -> dict:
    return {name: table[name][0] for name in table.column_names}


def resolved_contexts(chunks: DataFrame, flags: DataFrame, shape: Shape, buckets: int) -> DataFrame:
    """Notes of kind 1: the removed windows of each distinct context of a chunk and bucket."""
    width = shape.width + 2

    def send(key, left, right):
        if not left.num_rows:
            return _note_schema().empty_table()
        chunk = Chunk.read(_row(left), shape, buckets)
        found = chunk.contexts(_flags(chunk, right, 0))
        full = np.flatnonzero(np.diff(found.cuts))
        blobs = []
        for b in full:
            own = slice(found.cuts[b], found.cuts[b + 1])
            blobs.append(pack(found.rows[own].tobytes() + found.least[own].tobytes()))
        tidy()
        return pa.Table.from_batches([notes(key[0].as_py(), 1, full, blobs)])

    def meet(key, group):
        rows, least = [], []
        for data in group["data"]:
            raw = unpack(data, np.uint8)
            n = len(raw) // (width + 8)
            rows.append(raw[: n * width].reshape(n, width))
            least.append(raw[n * width :].copy().view(np.int64))
        bits = resolve(np.concatenate(rows), np.concatenate(least), shape)
        tidy()
        answers = [pack(b) for b in np.split(bits, np.cumsum([len(x) for x in least])[:-1])]
        n = len(answers)
        return pa.table({"uid": group["uid"], "bucket": pa.array(np.full(n, key[0].as_py(), np.int32)), "kind": pa.array(np.ones(n, np.int32)), "data": pa.array(answers, pa.binary())})

    sent = chunks.groupBy("uid").cogroup(flags.groupBy("uid")).applyInArrow(send, _NOTE)
    return sent.groupBy("bucket").applyInArrow(meet, _NOTE)


def _note_schema() -> pa.Schema:
    return pa.schema([("uid", pa.int64()), ("bucket", pa.int32()), ("kind", pa.int32()), ("data", pa.binary())])


def covered_bytes(chunk: Chunk, found: Contexts, bits: np.ndarray) -> np.ndarray:
    """Which bytes of the chunk lie in a removed window."""
    shape = chunk.shape
    starts = np.arange(shape.starts)
    valid = (starts >= shape.reach - found.left[:, None]) & (starts <= found.right[:, None])
    # Inside the chunk, only the first document of a context can be spared.
    later = chunk.ids[found.doc] > found.least[found.of]
    gone = valid & (later[:, None] | (bits[found.of][:, None] >> starts.astype(np.uint32) & 1 == 1))
    i, s = np.nonzero(gone)
    n = len(chunk.block.data)
    begins = np.zeros(n + shape.length, np.int32)
    begins[found.at[i] - shape.reach + s + shape.length] = 1
    total = np.cumsum(begins)
    return total[shape.length :] > total[:n]


def remove_repeats(docs: DataFrame, length: int = 50, gram: int = 24, chunk_bytes: int = 2 << 20, kept: bool = True, bucket_anchors: int = 100_000, hot: int = 1 << 15) -> DataFrame:
    """(doc_id, n_bytes, spans, kept_sha256, kept): spans are removed runs of bytes; kept (binary) is null unless asked for.  An anchor that stands `hot` times or more is dealt out."""
    spark, shape = docs.sparkSession, Shape(length, gram)
    if not 0 < shape.reach <= 31:
        raise ValueError("length - gram must lie between 1 and 31")
    shared_dir(spark)
    chunks = stored(chunk_rows(docs, shape, chunk_bytes), "chunks")
    buckets = 1 + (chunks.agg(F.sum("n_anchors")).first()[0] or 0) // bucket_anchors  # a worker holds one bucket's contexts
    flags = stored(shared_anchors(chunks, shape, buckets, hot), "shared-anchors")
    answers = stored(resolved_contexts(chunks, flags, shape, buckets), "windows")

    def cut(key, left, right):
        chunk = Chunk.read(_row(left), shape, buckets)
        found = chunk.contexts(_flags(chunk, right, 0))
        bits = np.zeros(len(found.rows), np.uint32)
        for bucket, kind, data in zip(right["bucket"].to_pylist(), right["kind"].to_pylist(), right["data"], strict=True):
            if kind == 1:
                bits[found.cuts[bucket] : found.cuts[bucket + 1]] = unpack(data, np.uint32)
        gone, block = covered_bytes(chunk, found, bits), chunk.block
        left_over = block.data[~gone].tobytes()
        ends = np.cumsum(np.concatenate([[0], np.diff(block.offsets) - block.per_doc(gone)]))
        edges = np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))
        cuts = np.unique(block.offsets[1:-1])
        cuts = cuts[(cuts > 0) & (cuts < len(gone))]
        cuts = cuts[gone[cuts] & gone[cuts - 1]]
        begin, end = np.sort(np.concatenate([np.flatnonzero(edges == 1), cuts])), np.sort(np.concatenate([np.flatnonzero(edges == -1), cuts]))
        doc = np.searchsorted(block.offsets, begin, "right") - 1
        per = np.searchsorted(doc, np.arange(block.n + 1)).astype(np.int32)
        spans = pa.StructArray.from_arrays([pa.array(begin - block.offsets[doc]), pa.array(end - block.offsets[doc])], names=["begin", "end"])
        texts = [left_over[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
        return pa.table({
            "doc_id": pa.array(chunk.ids, mask=unpack(left["missing"][0], bool)),
            "n_bytes": pa.array(np.diff(block.offsets)),
            "spans": pa.ListArray.from_arrays(pa.array(per), spans),
            "kept_sha256": pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()),
            "kept": pa.array(texts if kept else [None] * block.n, pa.binary()),
        })

    schema = "doc_id long, n_bytes long, spans array<struct<begin:long,end:long>>, kept_sha256 string, kept binary"
    return chunks.groupBy("uid").cogroup(flags.unionByName(answers).groupBy("uid")).applyInArrow(cut, schema)


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), kept=False)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["end"] - s["begin"])
    return done.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept_sha256")
