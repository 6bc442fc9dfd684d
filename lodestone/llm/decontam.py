"""Benchmark decontamination with an FM-index for each training shard.

A shard is a run of whole documents (about `shard_bytes`, so that a task needs little memory).  A benchmark window holds benchmark word pairs only, so the shard's
text is first reduced, without loss, to its runs of words in which every neighbouring pair stands in the benchmark; one-word
windows keep the single words.  Over those runs a suffix array (prefix doubling) gives the Burrows-Wheeler transform, a wavelet matrix
over it answers ranks, all windows of one length are searched backward at once, and occurrences are located by walking back to sampled
suffix positions.  Overlapping occurrences merge into removal spans.  Documents are never shuffled.

The benchmark is read on the driver in blocks of at most `block_bytes`; each block is one pass of the mapper over the documents,
and later passes merge their spans and items with the earlier ones, so no closure grows with the benchmark.

Defined cases: a null or empty text has no words and no hits; a null or empty item has no windows; equal windows of several items
count for each of them; rows with the same item_id are one item; an item without id counts as the empty id; repeated documents are
judged alike; empty tables give no rows, or clean documents; kept columns can't clash with the new ones.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import textkit as tk
from lodestone.llm.common import annotate, table

#: Words are runs of digits, lower-case ASCII letters and everything outside ASCII.
IS_WORD = np.zeros(256, bool)
IS_WORD[0x30:0x3A] = IS_WORD[0x61:0x7B] = IS_WORD[0x80:] = True

FIELDS = "n_words long, n_hit long, items array<string>, spans array<struct<begin:long,end:long>>"


class WaveletMatrix:
    """Rank and access over a sequence of small integers: one bit plane a level, zeros before ones."""

    def __init__(self, sequence: np.ndarray, sigma: int):
        self.levels = max(1, int(sigma - 1).bit_length())
        self.ones, self.zeros = [], []
        for level in reversed(range(self.levels)):
            bit = sequence >> level & 1
            ones = np.zeros(len(bit) + 1, np.int64)
            np.cumsum(bit, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(len(bit) - int(ones[-1]))
            sequence = np.concatenate([sequence[bit == 0], sequence[bit == 1]])

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before position at."""
        left, right = np.zeros_like(at), at
        for k, (ones, zeros) in enumerate(zip(self.ones, self.zeros, strict=True)):
            bit = symbols >> (self.levels - 1 - k) & 1 == 1
            left = np.where(bit, zeros + ones[left], left - ones[left])
            right = np.where(bit, zeros + ones[right], right - ones[right])
        return right - left

    def access_rank(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each position and how often it occurs before."""
        symbols, left, right = np.zeros_like(at), np.zeros_like(at), at
        for ones, zeros in zip(self.ones, self.zeros, strict=True):
            bit = ones[right + 1] - ones[right] == 1
            symbols = symbols * 2 + bit
            left = np.where(bit, zeros + ones[left], left - ones[left])
            right = np.where(bit, zeros + ones[right], right - ones[right])
        return symbols, right - left


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffixes of an integer sequence in order, by prefix doubling."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    order, k = np.argsort(rank, kind="stable"), 1
    while n > 1:
        after = np.zeros(n, np.int64)
        after[: n - k] = rank[k:] + 1
        key = rank * (n + 1) + after
        order = np.argsort(key, kind="stable")
        steps = np.empty(n, np.int64)
        steps[0] = 0
        steps[1:] = key[order[1:]] != key[order[:-1]]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(steps)
        k *= 2
        if rank[order[-1]] == n - 1 or k >= n:
            break
    return order


class FMIndex:
    """Over symbols 0 .. sigma - 1, of which 0 ends a run; inside, all move up by one and a single 0 closes the text."""

    def __init__(self, text: np.ndarray, sigma: int, sample: int = 8):
        text, sigma = np.append(text + 1, 0), sigma + 1
        order = suffix_array(text)
        bwt = text[order - 1]
        self.n = len(text)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma))])
        self.wavelet = WaveletMatrix(bwt, sigma)
        kept = order % sample == 0
        self.sampled, self.rows = kept, np.cumsum(kept) - 1
        self.positions = order[kept]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges [low, high) of the rows of a pattern matrix, searched from the last column to the first."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        alive = np.arange(len(patterns))
        for j in reversed(range(patterns.shape[1])):
            symbols = patterns[alive, j] + 1
            low[alive] = self.before[symbols] + self.wavelet.rank(symbols, low[alive])
            high[alive] = self.before[symbols] + self.wavelet.rank(symbols, high[alive])
            alive = alive[low[alive] < high[alive]]
            if not len(alive):
                break
        found = np.zeros(len(patterns), bool)
        found[alive] = True
        return np.where(found, low, 0), np.where(found, high, 0)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows: walk back until a sampled suffix, then add the steps."""
        out, walking, at, steps = np.empty(len(rows), np.int64), np.arange(len(rows)), rows.copy(), 0
        while len(walking):
            done = self.sampled[at]
            out[walking[done]] = self.positions[self.rows[at[done]]] + steps
            walking, at = walking[~done], at[~done]
            if len(walking):
                symbols, ranks = self.wavelet.access_rank(at)
                at = self.before[symbols] + ranks
            steps += 1
        return out


class Windows:
    """The distinct windows of a block of items as symbol matrices by length, with the items of each window."""

    def __init__(self, items: Sequence[tuple[str, str]], k: int):
        self.items = sorted({i for i, _ in items})
        number = {x: i for i, x in enumerate(self.items)}
        (block,) = tk.blocks(pa.array([t for _, t in items], pa.string()), 1 << 62)
        found = tk.words(block, IS_WORD, data=tk.LOWER[block.data])
        self.vocab, symbols = np.unique(found.hashes, return_inverse=True)
        symbols = symbols + 1
        by_window: dict[bytes, set[int]] = {}
        for (item, _), a, b in zip(items, found.first[:-1], found.first[1:], strict=True):
            size = min(k, b - a)
            for at in range(a, b - size + 1) if size else ():
                by_window.setdefault(symbols[at : at + size].tobytes(), set()).add(number[item])
        keys = sorted(by_window, key=lambda x: (len(x), x))
        self.sizes = np.array([len(x) // 8 for x in keys], np.int64)
        self.item_count = np.array([len(by_window[x]) for x in keys], np.int64)
        self.item_first = np.concatenate([[0], np.cumsum(self.item_count)])
        self.item_index = np.array([i for x in keys for i in sorted(by_window[x])], np.int64)
        self.groups = [(int(np.flatnonzero(self.sizes == s)[0]), np.array([np.frombuffer(x, np.int64) for x in keys if len(x) == 8 * s])) for s in np.unique(self.sizes)]
        self.sigma = len(self.vocab) + 1
        pairs = [m[:, j] * self.sigma + m[:, j + 1] for _, m in self.groups for j in range(m.shape[1] - 1)]
        self.pairs = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64)
        self.singles = np.concatenate([m[:, 0] for _, m in self.groups if m.shape[1] == 1] or [np.zeros(0, np.int64)])
        self.least = int(min([s for s in self.sizes if s > 1], default=0))

    def runs(self, symbols: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The reduced shard: symbols with a 0 behind each run, and the word index of each."""
        n = len(symbols)
        pair = np.zeros(n + 1, bool)  # pair[i]: words i - 1 and i
        if n > 1 and len(self.pairs):
            near = np.flatnonzero((symbols[:-1] > 0) & (symbols[1:] > 0) & (doc[:-1] == doc[1:]))
            pair[near + 1] = member(symbols[near] * self.sigma + symbols[near + 1], self.pairs)
        edges = np.diff(np.concatenate([[0], pair.astype(np.int8), [0]]))
        begins, ends = np.flatnonzero(edges == 1) - 1, np.flatnonzero(edges == -1)  # words begin .. end - 1
        long = ends - begins >= max(self.least, 2)
        begins, ends = begins[long], ends[long]
        if len(self.singles):
            alone = np.flatnonzero(np.isin(symbols, self.singles) & ~tk.covered(n, begins, ends - begins))
            begins, ends = np.concatenate([begins, alone]), np.concatenate([ends, alone + 1])
        sizes = ends - begins
        at = np.concatenate([[0], np.cumsum(sizes + 1)])
        text, where = np.zeros(at[-1], np.int64), np.full(at[-1], -1, np.int64)
        inside = np.ones(at[-1], bool)
        inside[at[1:] - 1] = False
        index = np.arange(at[-1]) - np.repeat(at[:-1], sizes + 1) + np.repeat(begins, sizes + 1)
        where[inside] = index[inside]
        text[inside] = symbols[index[inside]]
        return text, where

    def occurrences(self, symbols: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(word index, window) of every occurrence in a shard."""
        text, where = self.runs(symbols, doc)
        if not len(text):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        index = FMIndex(text, self.sigma)
        at, window = [], []
        for first, patterns in self.groups:
            low, high = index.search(patterns)
            counts = high - low
            rows = np.repeat(low - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
            at.append(where[index.locate(rows)])
            window.append(np.repeat(first + np.arange(len(patterns)), counts))
        return np.concatenate(at), np.concatenate(window)


def member(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    at = np.searchsorted(ordered, values)
    return ordered[np.minimum(at, len(ordered) - 1)] == values if len(ordered) else np.zeros(len(values), bool)


def symbols_of(hashes: np.ndarray, vocab: np.ndarray) -> np.ndarray:
    """1 + the place in the vocabulary, or 0.  A small bit table keeps most other words from the binary search."""
    out = np.zeros(len(hashes), np.int64)
    if len(vocab):
        table = np.zeros(1 << 16, bool)
        table[(vocab >> tk.U(48)).astype(np.int64)] = True
        maybe = np.flatnonzero(table[(hashes >> tk.U(48)).astype(np.int64)])
        at = np.minimum(np.searchsorted(vocab, hashes[maybe]), len(vocab) - 1)
        out[maybe] = np.where(vocab[at] == hashes[maybe], at + 1, 0)
    return out


def item_blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[str, str]]]:
    held, size = [], 0
    for item, text in benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")), F.coalesce("text", F.lit(""))).toLocalIterator():
        held.append((item, text))
        size += len(text)
        if size >= block_bytes:
            yield held
            held, size = [], 0
    if held:
        yield held


def find_contamination(docs: DataFrame, benchmark: DataFrame, k: int = 10, keep: Sequence[str] = ("doc_id",), cut: bool = False, block_bytes: int = 8 << 20, shard_bytes: int = 1 << 20) -> DataFrame:
    """row (struct of the kept columns), n_words, n_hit, items, spans (bytes of the text), and with cut the text without the spans."""
    found, waiting = None, [("", "")]
    for n, items in enumerate(item_blocks(benchmark, block_bytes)):
        if n:
            found = _one_pass(docs, found, Windows(waiting, k), keep, shard_bytes, _PASS)
        waiting = items
    return _one_pass(docs, found, Windows(waiting, k), keep, shard_bytes, _CUT if cut else _DROP)


#: What becomes of the text in a pass: it goes on to the next one, the last one cuts the spans out, or nobody needs it any more.
_PASS, _CUT, _DROP = "pass", "cut", "drop"


def _without(text: str | None, spans: list[dict]) -> str | None:
    if not spans:
        return text
    data, at, parts = text.encode(), 0, []
    for s in spans:
        parts.append(data[at : s["begin"]])
        at = s["end"]
    return b"".join([*parts, data[at:]]).decode()


def _one_pass(docs: DataFrame, found: DataFrame | None, windows: Windows, keep: Sequence[str], shard_bytes: int, then: str) -> DataFrame:
    if found is None:
        packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in keep)).alias("kept"), F.col("text"), F.lit(None).cast("array<string>").alias("items"), F.lit(None).cast("array<struct<begin:long,end:long>>").alias("spans"))
    else:
        packed = found.select(F.col("row").alias("kept"), "text", "items", "spans")

    def scan(column: pa.Array, row: pa.StructArray) -> list[pa.Array]:
        items, spans = row.field("items").to_pylist(), row.field("spans").to_pylist()
        n_words, n_hit, out_items, out_spans = [], [], [], []
        for block in tk.blocks(column, shard_bytes):
            found = tk.words(block, IS_WORD, data=tk.LOWER[block.data])
            symbols = symbols_of(found.hashes, windows.vocab)
            at, window = windows.occurrences(symbols, found.doc)
            hit = tk.covered(len(symbols), at, windows.sizes[window])
            for d in range(block.n) if any(spans[block.first : block.first + block.n]) else ():
                for s in spans[block.first + d] or ():
                    hit[found.first[d] : found.first[d + 1]] |= (found.starts[found.first[d] : found.first[d + 1]] >= s["begin"] + block.offsets[d]) & (found.starts[found.first[d] : found.first[d + 1]] < s["end"] + block.offsets[d])
            n_words.append(found.counts)
            n_hit.append(tk.sum_by(found.doc, hit, block.n).astype(np.int64))
            pairs = np.unique(found.doc[at] * len(windows.sizes) + window)
            pair_doc, pair_window = pairs // len(windows.sizes) if len(pairs) else pairs, pairs % len(windows.sizes) if len(pairs) else pairs
            counts = windows.item_count[pair_window]
            index = np.repeat(windows.item_first[pair_window] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum()) if len(pairs) else np.zeros(0, np.int64)
            of_doc = np.unique(np.repeat(pair_doc, counts) * max(1, len(windows.items)) + windows.item_index[index])
            names: list[list[str]] = [[] for _ in range(block.n)]
            for x in of_doc:
                names[x // len(windows.items)].append(windows.items[x % len(windows.items)])
            edges = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
            cuts = found.first[1:-1]
            begin_at, end_at = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
            cuts = cuts[(cuts > 0) & (cuts < len(hit))]
            cuts = np.unique(cuts[hit[cuts] & hit[cuts - 1]]) if len(cuts) else cuts  # a run of hit words ends with its document
            begin_at, end_at = np.sort(np.concatenate([begin_at, cuts])), np.sort(np.concatenate([end_at, cuts]))
            places: list[list[dict]] = [[] for _ in range(block.n)]
            for a, b in zip(begin_at.tolist(), end_at.tolist(), strict=True):
                d = int(found.doc[a])
                places[d].append({"begin": int(found.starts[a] - block.offsets[d]), "end": int(found.ends[b - 1] - block.offsets[d])})
            for d in range(block.n):
                out_items.append(sorted({*names[d], *(items[block.first + d] or ())}))
                out_spans.append(places[d])
        flat = lambda x: pa.array(np.concatenate(x) if x else [], pa.int64())
        span = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
        text = column
        if then == _DROP:
            text = pa.nulls(len(column), pa.string())
        elif then == _CUT and any(out_spans):
            text = pa.array([_without(t.as_py(), s) if s else t for t, s in zip(column, out_spans, strict=True)], pa.string())
        return [row.field("kept"), text, flat(n_words), flat(n_hit), pa.array(out_items, pa.list_(pa.string())), pa.array(out_spans, span)]

    made = annotate(packed, scan, f"kept {packed.schema['kept'].dataType.simpleString()}, text string, " + FIELDS, keep=("kept", "items", "spans"))
    return made.select(F.col("kept").alias("row"), *([] if then == _DROP else ["text"]), "n_words", "n_hit", "items", "spans")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "row.doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


OP5_SQL = r"""
WITH doc AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), item AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), win AS (
  SELECT DISTINCT item, least(10, len(w)) AS k, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS s
  FROM (SELECT item, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM item WHERE len(w) > 0)
), place AS (
  SELECT doc_id, k, i, array_to_string(w[i : i + k - 1], ' ') AS s
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM doc, (SELECT DISTINCT k FROM win))
), hit AS (
  SELECT doc_id, p.k, i, item FROM place p JOIN win USING (k, s)
), word AS (
  SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + k)) AS j FROM hit) GROUP BY doc_id
), named AS (
  SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hit GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN word USING (doc_id) LEFT JOIN named USING (doc_id)
"""
