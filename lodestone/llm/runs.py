"""Periodic runs of words by Lyndon arrays, after Ellert and Fischer: every repetition that goes on at least four times, found without suffix structures or fingerprints.

A run is a stretch of words with smallest period q (words q apart are identical) and at least max(6, 4 q) words that no neighbouring word extends.
Each one holds, for the order of words or for its reverse, a Lyndon word of length q that starts in its first q words and ends where the
next smaller suffix starts.  So it is enough to know for every place its next smaller suffix and how far the two agree, in both orders:

* words get ranks by sorting their bytes, seven at a time; nothing is hashed
* places are read from left to right against the chain of previous smaller suffixes.  The furthest agreement so far is a window: what lies in it
  repeats earlier text, so results in it are copied, and letters are compared only beyond its end.  Each comparison moves that end, so the
  array takes linear time on every text
* a Lyndon word that agrees with what follows for two more periods gives a run; it is then extended to the left by less than one period

Before that, words that can't be in a run are cut away, without loss: in a run every word occurs four times and every pair of adjacent words
three times, so stretches without such pairs are left out until nothing more goes.

Defined cases: a null or empty text has no words and no runs; ids may be null or repeat, for every row is judged alone; an empty table gives no
rows; kept columns travel inside `row`, whatever their names; a very long text is a block of its own, in memory of some 60 bytes a word.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import WORD, annotate, folds, table
from lodestone.llm.textkit import U, blocks, words

#: Steps of seven bytes after which what is left of long words is compared whole.
_STEPS = 16
_STEP_MASK = np.array([((1 << 8 * i) - 1) << (64 - 8 * i) for i in range(8)], U)

_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def ranks(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """How many spans are smaller, by bytes: equal spans have equal ranks, and the order of ranks is that of the bytes."""
    out = np.zeros(len(starts), np.int64)
    loads = np.ndarray(len(data) + 1, ">u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))
    on, at = np.arange(len(starts)), starts
    for step in range(_STEPS + 1):
        if not len(on):
            break
        left = ends[on] - at
        if step < _STEPS:
            key = (loads[at].astype(U) & _STEP_MASK[np.minimum(left, 7)]) | np.minimum(left, 8).astype(U)
        else:
            rest = [data[a : a + n].tobytes() for a, n in zip(at.tolist(), left.tolist(), strict=True)]
            key = np.zeros(len(on), np.int64)
            order = sorted(range(len(on)), key=rest.__getitem__)
            key[order] = np.cumsum([False, *(rest[a] != rest[b] for a, b in zip(order, order[1:], strict=False))])
        order = np.lexsort((key, out[on])) if step else np.argsort(key, kind="stable")
        group, key = out[on][order], key[order]
        place = np.arange(len(on))
        new_group = np.r_[True, group[1:] != group[:-1]]
        new_key = new_group | np.r_[True, key[1:] != key[:-1]]
        group_at = np.maximum.accumulate(np.where(new_group, place, 0))
        key_at = np.maximum.accumulate(np.where(new_key, place, 0))
        out[on[order]] = group + key_at - group_at
        more = (left > 7) & (step < _STEPS)
        on, at = on[more], at[more] + 7
    return out


def _often(codes: np.ndarray, least: int) -> np.ndarray:
    """Which codes occur at least so often."""
    order = np.argsort(codes, kind="stable")
    ordered = codes[order]
    first = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]]) if len(codes) else np.zeros(0, np.int64)
    size = np.diff(np.r_[first, len(codes)])
    out = np.zeros(len(codes), bool)
    out[order] = np.repeat(size >= least, size)
    return out


def stretches(rank: np.ndarray, doc: np.ndarray) -> list[tuple[int, int]]:
    """Word ranges [from, to) that hold every run: each lies in one document, and in it every pair of adjacent words occurs three times."""
    n = len(rank)
    if n < 6:
        return []
    good = _often(doc * n + rank, 4)
    at = np.flatnonzero(good[1:] & good[:-1] & (doc[1:] == doc[:-1]))
    while len(at):
        piece = np.cumsum(np.r_[0, np.diff(at) != 1])
        keep = np.bincount(piece)[piece] >= 5
        order = np.lexsort((rank[at + 1], rank[at], piece))
        p, a, b = piece[order], rank[at][order], rank[at + 1][order]
        same = np.r_[False, (p[1:] == p[:-1]) & (a[1:] == a[:-1]) & (b[1:] == b[:-1])]
        pair = np.empty(len(at), np.int64)
        pair[order] = np.cumsum(~same)
        keep &= _often(pair, 3)
        if keep.all():
            break
        at = at[keep]
    if not len(at):
        return []
    cut = np.flatnonzero(np.diff(at) != 1)
    return list(zip(at[np.r_[0, cut + 1]].tolist(), (at[np.r_[cut, len(at) - 1]] + 2).tolist(), strict=True))


def next_smaller(s: Sequence[int]) -> tuple[list[int], list[int]]:
    """For every place the start of its next smaller suffix (the end counts as the smallest) and the length of their common prefix, in linear time."""
    n = len(s)
    follows, agree = [n] * n, [0] * n  # next smaller suffix, common prefix with it
    before, shared = [-1] * n, [0] * n  # previous smaller suffix, common prefix with it
    begin = end = shift = 0  # s[begin:end] repeats what stands shift earlier, and nothing was compared beyond end
    for i in range(1, n):
        j, size, unknown = i - 1, 0, True
        while True:
            if unknown:
                scan = True
                if begin <= j and i < end:
                    size = agree[j - shift] if follows[j - shift] == i - shift else shared[i - shift]
                    scan = i + size >= end
                    if scan:
                        size = end - i
                if scan:
                    k, m = i + size, j + size
                    while k < n and s[m] == s[k]:
                        k += 1
                        m += 1
                    size = k - i
                    if k >= end:
                        begin, end, shift = i, k, i - j
                if i + size < n and s[j + size] < s[i + size]:
                    before[i], shared[i] = j, size
                    break
            follows[j], agree[j] = i, size
            j, known = before[j], shared[j]
            if j < 0:
                break
            if known < size:  # the one before j parts from it first
                before[i], shared[i] = j, known
                break
            unknown = known == size  # else it parts from i where j does
    return follows, agree


def runs_of(s: Sequence[int]) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start, then period."""
    found = set()
    for letters in (s, [-x for x in s]):
        follows, agree = next_smaller(letters)
        for i, (j, right) in enumerate(zip(follows, agree, strict=True)):
            period = j - i
            if right < 2 * period or (i >= period and follows[i - period] == i and agree[i - period] >= period):
                continue
            left = 0
            while left < i and letters[i - left - 1] == letters[j - left - 1]:
                left += 1
            length = left + period + right
            if length >= max(6, 4 * period):
                found.add((i - left, length, period))
    return sorted(found, key=lambda r: (r[0], r[2]))


def _found(texts: pa.Array, rows: pa.Array) -> list[pa.Array]:
    runs, collapsed = [], []
    for block in blocks(texts):
        w = words(block, hashed=False)
        rank = ranks(block.data, w.starts, w.ends)
        of_doc: dict[int, list] = {}
        for lo, hi in stretches(rank, w.doc):
            got = runs_of(rank[lo:hi].tolist())
            if got:
                doc = int(w.doc[lo])
                of_doc.setdefault(doc, []).extend((lo - int(w.first[doc]) + start, length, period) for start, length, period in got)
        for doc in range(block.n):
            parts = block.data[block.offsets[doc] : block.offsets[doc + 1]].tobytes().split()  # ASCII white space, as in WORD
            if own := of_doc.get(doc, []):
                steps = np.zeros(len(parts) + 1, np.int64)
                for start, length, period in own:
                    steps[start + period] += 1
                    steps[start + length] -= 1
                parts = [parts[k] for k in np.flatnonzero(np.cumsum(steps[:-1]) == 0).tolist()]
            runs.append([{"start": a, "length": b, "period": c} for a, b, c in own])
            collapsed.append(b" ".join(parts))
    return [pa.array(runs, _RUNS), pa.array(collapsed, pa.binary()).cast(pa.string())]


def find_runs(docs: DataFrame, keep: Sequence[str] = ("doc_id",), text: str = "text") -> DataFrame:
    """(row, runs, collapsed): the kept columns, every run by start, then period, and the words with each run cut to its first period, joined by one space."""
    return annotate(docs, _found, "runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string", keep, text)


def wound(text: Column, key: Column) -> Column:
    """The text as its words, repeated from word g % n on with period 1 + (n - g % n) / (3 + g % 8) where key % 10 = 0 and it has n > 0 words; g = key / 10."""
    g = F.floor(key / 10)
    parts = F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", -1), lambda w: w != "")

    def turned(ws: Column) -> Column:
        n = F.size(ws).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        return F.array_join(F.transform(ws, lambda w, i: F.when(i < a, w).otherwise(F.get(ws, (a + (i - a) % p).cast("int")))), " ")

    return F.when((key % 10 == 0) & F.coalesce(text, F.lit("")).rlike(WORD), F.element_at(F.transform(F.array(parts), turned), 1)).otherwise(text)


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", wound(F.col("text"), folds(F.col("doc_id"), 1 << 32)).alias("text"))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    told = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    return find_runs(docs).withColumn("best", best).select(
        "row.doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.start")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"),
        F.floor(1000 * F.col("best.length") / -F.col("best.period")).alias("exponent_milli"),
        F.sha2(told, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


#: crc32 of a decimal id, bit by bit, for SQL dialects without it.
CRC32_SQL = """xor(4294967295::BIGINT, list_reduce(list_concat([4294967295::BIGINT], list_transform(range(len({0})::BIGINT * 9),
  lambda k: CASE WHEN k % 9 = 0 THEN ascii(substr({0}, (k // 9 + 1)::BIGINT, 1))::BIGINT ELSE -1 END)),
  lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384::BIGINT) ELSE a // 2 END))"""

OP11_SQL = rf"""
WITH keyed AS (
  SELECT row_number() OVER () AS r, doc_id, {CRC32_SQL.format("coalesce(doc_id::VARCHAR, '')")} AS h,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), measured AS (
  SELECT *, len(ws) AS n, CASE WHEN len(ws) > 0 THEN (h // 10) % len(ws) END AS a FROM keyed
), turned AS (
  SELECT r, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: ws[CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + (h // 10) % 8)) END + 1]) ELSE ws END AS ws FROM measured
), word AS (
  SELECT r, n, unnest(range(n)) AS i, unnest(ws) AS w FROM turned
), often AS (
  SELECT r, n, i, w FROM word QUALIFY count(*) OVER (PARTITION BY r, w) >= 4
), same AS (
  SELECT x.r, y.i - x.i AS q, x.i FROM often x JOIN often y ON x.r = y.r AND x.w = y.w AND y.i > x.i AND 4 * (y.i - x.i) <= x.n
), island AS (
  SELECT r, q, min(i) AS start, count(*) + q AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS k FROM same) GROUP BY r, q, k
), long_ones AS (
  SELECT * FROM island WHERE length >= greatest(6, 4 * q)
), run AS (
  SELECT * FROM long_ones x WHERE NOT EXISTS (SELECT 1 FROM island y WHERE y.r = x.r AND y.q < x.q AND y.start <= x.start AND y.start + y.length >= x.start + x.length)
), told AS (
  SELECT r, count(*) AS n_runs, string_agg(start || ',' || length || ',' || q || chr(10), '' ORDER BY start, q) AS said,
    first(start ORDER BY length DESC, start, q) AS start, first(q ORDER BY length DESC, start, q) AS period, max(length) AS length FROM run GROUP BY r
), kept AS (
  SELECT r, string_agg(w, ' ' ORDER BY i) AS words FROM word WHERE NOT EXISTS (SELECT 1 FROM run WHERE run.r = word.r AND word.i >= run.start + run.q AND word.i < run.start + run.length) GROUP BY r
)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, 1000 * length // period AS exponent_milli,
  sha256(coalesce(said, '')) AS runs_sha256, sha256(coalesce(words, '')) AS collapsed_sha256
FROM turned LEFT JOIN told USING (r) LEFT JOIN kept USING (r)
"""
