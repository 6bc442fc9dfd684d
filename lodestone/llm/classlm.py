"""LM scoring with a class-based bigram model: P(w | v) = P(class(w) | class(v)) * P(w | class(w)).

1. Counts.  Every training token is counted by a 64-bit key: 54 bits of the word's hash and 10 bits for its shape (length and last two bytes).  Tasks
   send sorted key and count arrays a bucket, so the shuffle carries a word once a task.  The counts stay a table.
2. Core.  Words that make up at least 1 / `unit_share` of the training tokens are units of their own (so there are at most that many, whatever the corpus); all others are
   grouped by shape into 1,023 units, and the end token is a unit.  Exchange clustering on the unit bigrams: units move to the class that raises the likelihood of
   the class bigrams most, sweep after sweep until none moves.
3. Classes.  Every other word counted `least_count` times or more, a vocabulary that grows with the corpus, is exchanged by its own bigrams: tasks sum the classes before and after each word and
   send them to the word's bucket, which moves it to the class that makes its whole count vector likeliest.  Only rarer words keep the class of their shape.  The classes stay a table.
4. Scores.  The buckets answer each piece of text with count and class of its distinct words, the class bigrams are counted anew, and P(class | class) is smoothed towards class
   frequencies; P(w | class) adds 0.5 to each word of the class and one unseen word.

Buckets are as many as the bytes of the texts ask for; a frequent word sends at most 2 * `classes` counts a task to its bucket.

Defined cases: a null or empty text is the end token alone; the end token follows itself at the start of a text; rows without id belong to the fold of the empty id; an id that is no whole number
is an error; repeated rows count as often as they stand there and score alike; without training rows all counts are 0; a text longer than a piece is a piece of its own; further columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import textkit as tk
from lodestone.llm.common import discard, folds, integral, shared_dir, stored, table, tidy

SHAPES = 1024
END = np.array([(1 << 63) | (SHAPES - 1)], tk.U)  # its shape is its own
_LOW = tk.U(SHAPES - 1)


def tokens(block: tk.Block) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all tokens, each document closed by END, and the document of each."""
    data = tk.LOWER[block.data]
    found = tk.words(block, data=data)
    size = found.ends - found.starts
    last = data[found.ends - 1].astype(tk.U)
    before = np.where(size > 1, data[np.maximum(found.ends - 2, 0)], 0).astype(tk.U)
    shape = tk.mix(last << tk.U(16) | before << tk.U(8) | np.minimum(size, 12).astype(tk.U)) % tk.U(SHAPES - 1)
    keys = (found.hashes & ~_LOW) | shape
    out = np.empty(len(keys) + block.n, tk.U)
    is_end = np.zeros(len(out), bool)
    is_end[found.first[1:] + np.arange(block.n)] = True
    out[is_end], out[~is_end] = END[0], keys
    return out, np.repeat(np.arange(block.n), found.counts + 1)


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((keys >> tk.U(32)) * tk.U(buckets) >> tk.U(32)).astype(np.int64)


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    keys = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    at = np.flatnonzero(new)
    return keys[at], (np.add.reduceat(counts[order], at) if len(at) else counts[:0])


def joined(column: pa.ChunkedArray, kind) -> np.ndarray:
    return np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in column] or [np.zeros(0, kind)])


def count_words(texts: DataFrame, buckets: int) -> DataFrame:
    """(bucket, keys, counts): training counts, one row a bucket, keys in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, counts = [np.zeros(0, tk.U)], [np.zeros(0, np.int64)]
            train = np.asarray(batch.column(1))
            for block in tk.blocks(batch.column(0)):
                found, doc = tokens(block)
                k, c = np.unique(found[train[block.first + doc]], return_counts=True)
                keys.append(k)
                counts.append(c)
            k, c = summed(np.concatenate(keys), np.concatenate(counts))
            cuts = np.searchsorted(bucket_of(k, buckets), np.arange(buckets + 1))
            full = np.flatnonzero(np.diff(cuts))
            yield pa.RecordBatch.from_arrays([
                pa.array(full, pa.int32()),
                pa.array([k[cuts[b] : cuts[b + 1]].tobytes() for b in full], pa.binary()),
                pa.array([c[cuts[b] : cuts[b + 1]].tobytes() for b in full], pa.binary()),
            ], names=["bucket", "keys", "counts"])
            tidy()

    def merge(key, group):
        k, c = summed(joined(group["keys"], tk.U), joined(group["counts"], np.int64))
        return pa.table({"bucket": pa.array([key[0].as_py()], pa.int32()), "keys": pa.array([k.tobytes()], pa.binary()), "counts": pa.array([c.tobytes()], pa.binary())})

    schema = "bucket int, keys binary, counts binary"
    return texts.select("text", "train").mapInArrow(run, schema).groupBy("bucket").applyInArrow(merge, schema)


def shape_totals(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and types of each shape."""

    def run(batches):
        tokens_of, types_of = np.zeros(SHAPES, np.int64), np.zeros(SHAPES, np.int64)
        for batch in batches:
            for keys, n in zip(batch.column(0), batch.column(1), strict=True):
                shape = (np.frombuffer(keys.as_buffer(), tk.U) & _LOW).astype(np.int64)
                tokens_of += np.bincount(shape, np.frombuffer(n.as_buffer(), np.int64), SHAPES).astype(np.int64)
                types_of += np.bincount(shape, minlength=SHAPES)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(SHAPES)), pa.array(tokens_of), pa.array(types_of)], names=["shape", "tokens", "types"])

    rows = counts.select("keys", "counts").mapInArrow(run, "shape long, tokens long, types long").groupBy("shape").agg(F.sum("tokens").alias("tokens"), F.sum("types").alias("types")).collect()
    tokens_of, types_of = np.zeros(SHAPES, np.int64), np.zeros(SHAPES, np.int64)
    for r in rows:
        tokens_of[r["shape"]], types_of[r["shape"]] = r["tokens"], r["types"]
    return tokens_of, types_of


def frequent(counts: DataFrame, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Keys in order and counts of the words counted at least `least` times: a share of all tokens, so their number is bounded."""

    def run(batches):
        for batch in batches:
            for keys, n in zip(batch.column(0), batch.column(1), strict=True):
                k, c = np.frombuffer(keys.as_buffer(), tk.U), np.frombuffer(n.as_buffer(), np.int64)
                kept = c >= least
                yield pa.RecordBatch.from_arrays([pa.array(k[kept].view(np.int64)), pa.array(c[kept])], names=["key", "n"])

    rows = counts.select("keys", "counts").mapInArrow(run, "key long, n long").toPandas()
    keys, n = rows["key"].to_numpy(np.int64).view(tk.U), rows["n"].to_numpy(np.int64)
    order = np.argsort(keys)
    return keys[order], n[order]


@dataclass
class Units:
    keys: np.ndarray  # frequent words, in order
    size: int

    @classmethod
    def of(cls, keys: np.ndarray) -> Units:
        keys = np.unique(np.append(keys, END))
        return cls(keys, len(keys) + SHAPES - 1)

    def number(self, keys: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, at, len(self.keys) + (keys & _LOW).astype(np.int64))

    @property
    def end(self) -> int:
        return int(np.searchsorted(self.keys, END[0]))


def before_each(values: np.ndarray, doc: np.ndarray, start: int) -> np.ndarray:
    """The value in front of each token of the same document, and `start` in front of the first."""
    out = np.empty_like(values)
    out[1:] = values[:-1]
    first = np.ones(len(values), bool)
    first[1:] = doc[1:] != doc[:-1]
    out[first] = start
    return out


def unit_bigrams(texts: DataFrame, units: Units, rows_a_chunk: int = 64) -> np.ndarray:
    """The matrix of unit bigrams over all training tokens; its size is fixed by the number of units."""
    size = units.size

    def run(batches):
        total = np.zeros(size * size, np.int32)
        for batch in batches:
            train = np.asarray(batch.column(1))
            for block in tk.blocks(batch.column(0)):
                keys, doc = tokens(block)
                unit = units.number(keys)
                pairs = before_each(unit, doc, units.end) * size + unit
                at, n = np.unique(pairs[train[block.first + doc]], return_counts=True)
                total[at] += n.astype(np.int32)
            tidy()
        for chunk in range(0, size, rows_a_chunk):
            part = total[chunk * size : (chunk + rows_a_chunk) * size]
            at = np.flatnonzero(part)
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([at.astype(np.int32).tobytes()]), pa.array([part[at].astype(np.int64).tobytes()])], names=["chunk", "at", "n"])

    def merge(key, group):
        at, n = summed(joined(group["at"], np.int32), joined(group["n"], np.int64))
        return pa.table({"chunk": pa.array([key[0].as_py()], pa.int32()), "at": pa.array([at.tobytes()]), "n": pa.array([n.tobytes()])})

    schema = "chunk int, at binary, n binary"
    out = np.zeros(size * size, np.int64)
    for r in texts.select("text", "train").mapInArrow(run, schema).groupBy("chunk").applyInArrow(merge, schema).toLocalIterator():
        out[r["chunk"] * size + np.frombuffer(r["at"], np.int32)] = np.frombuffer(r["n"], np.int64)
    return out.reshape(size, size)


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def exchange(bigrams: np.ndarray, classes: int, alone: int) -> np.ndarray:
    """Class of each unit.  `alone` has class 0 to itself; the others start by frequency, dealt in turn.  Sweeps go on until no unit moves; as each move raises the likelihood by more than
    the rounding errors of its sums, they come to an end."""
    size = len(bigrams)
    out_of, into = bigrams.sum(1), bigrams.sum(0)
    order = np.argsort(-(out_of + into), kind="stable")
    order = order[order != alone]
    of = np.zeros(size, np.int64)
    of[order] = 1 + np.arange(len(order)) % (classes - 1)
    table = np.zeros((classes, classes))
    np.add.at(table, (of[:, None], of[None, :]), bigrams)
    left, right = table.sum(1), table.sum(0)
    margin, moved = 1e-9 + 1e-10 * bigrams.sum(), 1
    while moved:
        moved = 0
        for u in order:
            if not out_of[u] + into[u]:
                break
            r, c, own, a = np.bincount(of, bigrams[u], classes), np.bincount(of, bigrams[:, u], classes), bigrams[u, u], of[u]
            r[a] -= own
            c[a] -= own
            table[a] -= r
            table[:, a] -= c
            table[a, a] -= own
            left[a] -= out_of[u]
            right[a] -= into[u]
            rows, columns, corner = _xlogx(table + r) - _xlogx(table), _xlogx(table + c[:, None]) - _xlogx(table), np.diag(table)
            gain = rows.sum(1) - np.diag(rows) + columns.sum(0) - np.diag(columns) + _xlogx(corner + r + c + own) - _xlogx(corner)
            gain -= _xlogx(left + out_of[u]) - _xlogx(left) + _xlogx(right + into[u]) - _xlogx(right)
            gain[0] = -np.inf
            b = int(np.argmax(gain))
            if gain[b] <= gain[a] + margin:
                b = a
            moved += b != a
            of[u] = b
            table[b] += r
            table[:, b] += c
            table[b, b] += own
            left[b] += out_of[u]
            right[b] += into[u]
    return of


@dataclass
class Core:
    units: Units
    class_of: np.ndarray
    table: np.ndarray  # class bigrams of the units
    tokens: int
    types: int


def fit_core(counts: DataFrame, texts: DataFrame, classes: int, unit_share: int) -> Core:
    shape_tokens, shape_types = shape_totals(counts)
    n, v = int(shape_tokens.sum()), int(shape_types.sum())
    keys, _ = frequent(counts, max(n / unit_share, 1))
    units = Units.of(keys)
    bigrams = unit_bigrams(texts, units)
    class_of = exchange(bigrams, classes, units.end)
    table = np.zeros((classes, classes))
    np.add.at(table, (class_of[:, None], class_of[None, :]), bigrams)
    return Core(units, class_of, table, n, v)


CELLS = "bucket int, data binary"


def merged(keys: np.ndarray, cells: np.ndarray, n: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums n by key and cell, in order of both."""
    own, place = np.unique(keys, return_inverse=True)
    code, at = np.unique(place * (2 * classes) + cells, return_inverse=True)
    return own[code // (2 * classes)], (code % (2 * classes)).astype(np.int64), np.bincount(at, n, len(code)).astype(np.int64)


def neighbour_cells(texts: DataFrame, core: Core, buckets: int, at_once: int = 1 << 20) -> DataFrame:
    """(bucket, data): for words below the core, how often each class stands before (cell c) and after (cell classes + c) them in training texts.  A task sums what it can hold."""
    classes = len(core.table)

    def sent(keys, cells, n):
        own, first = np.unique(keys, return_index=True)
        cuts = np.searchsorted(bucket_of(own, buckets), np.arange(buckets + 1))
        full, first = np.flatnonzero(np.diff(cuts)), np.append(first, len(keys))
        pack, blobs = zstandard.ZstdCompressor(level=1), []
        for b in full:
            a, z = first[cuts[b]], first[cuts[b + 1]]
            sizes = np.diff(first[cuts[b] : cuts[b + 1] + 1])
            blobs.append(pack.compress(b"".join([np.array([cuts[b + 1] - cuts[b], z - a]).tobytes(), own[cuts[b] : cuts[b + 1]].tobytes(), n[a:z].tobytes(), sizes.astype(np.int32).tobytes(), cells[a:z].astype(np.uint8).tobytes()])))
        return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(blobs, pa.binary())], names=["bucket", "data"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            train = np.asarray(batch.column(1))
            for block in tk.blocks(batch.column(0)):
                keys, doc = tokens(block)
                number = core.units.number(keys)
                kind = core.class_of[number]
                chosen = np.flatnonzero(train[block.first + doc] & (number >= len(core.units.keys)))
                before, after = before_each(kind, doc, 0)[chosen], np.append(kind[1:], 0)[chosen]
                held.append(merged(np.concatenate([keys[chosen], keys[chosen]]), np.concatenate([before, after + classes]), np.ones(2 * len(chosen), np.int64), classes))
                size += len(held[-1][0])
                if size > at_once:
                    held = [merged(*map(np.concatenate, zip(*held, strict=True)), classes)]
                    size = len(held[0][0])
                    if size > at_once // 2:
                        yield sent(*held[0])
                        held, size = [], 0
            tidy()
        if held:
            yield sent(*merged(*map(np.concatenate, zip(*held, strict=True)), classes))
        tidy()

    return texts.select("text", "train").mapInArrow(run, CELLS)


def read_cells(data: pa.Scalar) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, cells of each, and cells and counts in a row."""
    raw = zstandard.ZstdDecompressor().decompress(data.as_buffer())
    m, n = np.frombuffer(raw, np.int64, 2)
    keys, counts = np.frombuffer(raw, tk.U, m, 16), np.frombuffer(raw, np.int64, n, 16 + 8 * m)
    sizes = np.frombuffer(raw, np.int32, m, 16 + 8 * m + 8 * n)
    return keys, sizes, np.frombuffer(raw, np.uint8, n, 16 + 12 * m + 8 * n), counts


def choose(vectors: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The class, never 0, that makes the class bigrams of each word likeliest; a vector has the counts of classes before, then of classes after."""
    smooth = table + 0.5
    share = np.log(smooth / (smooth.sum(1, keepdims=True) * smooth.sum(0, keepdims=True)))
    classes = len(table)
    gain = vectors[:, :classes] @ share + vectors[:, classes:] @ share.T
    gain[:, 0] = -np.inf
    return np.argmax(gain, 1)


CLASSED = "bucket int, keys binary, counts binary, kinds binary, class_tokens array<long>, class_types array<long>"


def assign(cells: DataFrame, counts: DataFrame, core: Core, least_count: int) -> DataFrame:
    """counts with the class of each word, and tokens and types of each class in the bucket."""
    classes = len(core.table)

    def look(key, found, known):
        k, c = joined(known["keys"], tk.U), joined(known["counts"], np.int64)
        number = core.units.number(k)
        kind = core.class_of[number].copy()
        middle = np.flatnonzero((number >= len(core.units.keys)) & (c >= least_count))
        row = np.full(len(k), -1)
        row[middle] = np.arange(len(middle))
        vectors = np.zeros(len(middle) * 2 * classes)
        for data in found["data"] if len(middle) else []:
            own, sizes, cell, n = read_cells(data)  # all of them training words of this bucket
            to = np.repeat(row[np.searchsorted(k, own)], sizes)
            np.add.at(vectors, (to * 2 * classes + cell)[to >= 0], n[to >= 0])
        kind[middle] = choose(vectors.reshape(-1, 2 * classes), core.table)
        per = [np.bincount(kind, w, classes).astype(np.int64) for w in (c, None)]
        del vectors
        tidy()
        return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([k.tobytes()]), pa.array([c.tobytes()]), pa.array([kind.astype(np.uint8).tobytes()]), *(pa.array([x], pa.list_(pa.int64())) for x in per)], names=[x.split()[0] for x in CLASSED.split(", ")])

    return cells.groupBy("bucket").cogroup(counts.groupBy("bucket")).applyInArrow(look, CLASSED)


ASKED = "uid long, bucket int, keys binary, places binary, sizes binary, ids array<long>, held array<boolean>"


def ask(texts: DataFrame, buckets: int, piece_bytes: int = 2 << 20) -> DataFrame:
    """Rows without bucket, one a piece of the texts: its tokens as places among its distinct keys.  Rows with one, one a bucket and piece: distinct keys."""
    names = [x.split()[0] for x in ASKED.split(", ")]
    kinds = [pa.int64(), pa.int32(), *[pa.binary()] * 3, pa.list_(pa.int64()), pa.list_(pa.bool_())]

    def run(batches):
        for batch in batches:
            ids, held = batch.column(1), batch.column(2)
            for block in tk.blocks(batch.column(0), piece_bytes):
                uid = uuid.uuid4().int >> 65
                keys, doc = tokens(block)
                own, place = np.unique(keys, return_inverse=True)
                cuts = np.searchsorted(bucket_of(own, buckets), np.arange(buckets + 1))
                at = (block.first, block.n)
                rows = [(uid, None, None, place.astype(np.int32).tobytes(), np.bincount(doc, minlength=block.n).tobytes(), ids.slice(*at).to_pylist(), held.slice(*at).to_pylist())]
                rows += [(uid, int(b), own[cuts[b] : cuts[b + 1]].tobytes(), None, None, None, None) for b in np.flatnonzero(np.diff(cuts))]
                yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                del rows, keys, doc, own, place
            tidy()

    return texts.select("text", "doc_id", "held_out").mapInArrow(run, ASKED)


def answer(asked: DataFrame, classed: DataFrame, core: Core) -> DataFrame:
    """(uid, bucket, counts, classes) for the keys of each asking row."""

    def look(key, requests, known):
        k, c, kind = joined(known["keys"], tk.U), joined(known["counts"], np.int64), joined(known["kinds"], np.uint8)
        counts, kinds = [], []
        for keys in requests["keys"]:
            own = np.frombuffer(keys.as_buffer(), tk.U)
            at = np.minimum(np.searchsorted(k, own), max(len(k) - 1, 0))
            hit = k[at] == own if len(k) else np.zeros(len(own), bool)
            shape = core.class_of[core.units.number(own)]
            counts.append((np.where(hit, c[at], 0) if len(k) else np.zeros(len(own), np.int64)).tobytes())
            kinds.append((np.where(hit, kind[at], shape) if len(k) else shape).astype(np.uint8).tobytes())
        tidy()
        return pa.table([requests["uid"], pa.array([key[0].as_py()] * len(counts), pa.int32()), pa.array(counts, pa.binary()), pa.array(kinds, pa.binary())], names=["uid", "bucket", "counts", "classes"])

    return asked.groupBy("bucket").cogroup(classed.groupBy("bucket")).applyInArrow(look, "uid long, bucket int, counts binary, classes binary")


READ = "doc_id long, held_out boolean, n_tokens long, n_known long, logs double, classes binary"


def read_back(batches: DataFrame, answers: DataFrame) -> DataFrame:
    """A row for each document: its counts and the class of each of its tokens."""

    def read(key, own, found):
        order = np.argsort(found["bucket"].to_numpy())
        found = found.take(order)
        count, kind = joined(found["counts"], np.int64), joined(found["classes"], np.uint8)
        place, size = joined(own["places"], np.int32), joined(own["sizes"], np.int64)
        doc = np.repeat(np.arange(len(size)), size)
        n, ends, kinds = count[place], np.append(0, np.cumsum(size)), kind[place]
        del found, count, kind, place
        tidy()
        return pa.table({
            "doc_id": pa.array(own["ids"][0].as_py(), pa.int64()), "held_out": pa.array(own["held"][0].as_py(), pa.bool_()), "n_tokens": pa.array(size),
            "n_known": pa.array(np.bincount(doc[n > 0], minlength=len(size))), "logs": pa.array(np.bincount(doc, np.log10(n + 0.5), len(size))),
            "classes": pa.array([kinds[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary()),
        })

    return batches.groupBy("uid").cogroup(answers.groupBy("uid")).applyInArrow(read, READ)


def _pairs(column: pa.Array, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and class bigram, as one number, of each token."""
    size = np.array([len(x.as_buffer()) for x in column], np.int64)
    kind, doc = joined(column, np.uint8).astype(np.int64), np.repeat(np.arange(len(size)), size)
    return doc, (before_each(kind, doc, 0) * classes + kind if len(kind) else kind)


def class_bigrams(documents: DataFrame, classes: int) -> np.ndarray:
    def run(batches):
        total = np.zeros(classes * classes, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                total += np.bincount(_pairs(batch.column(0).slice(at, 1000), classes)[1], minlength=classes * classes)
            tidy()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(classes * classes)), pa.array(total)], names=["at", "n"])

    out = np.zeros(classes * classes)
    for r in documents.where("NOT held_out").select("classes").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
        out[r["at"]] = r["n"]
    return out.reshape(classes, classes)


def fit_classes(texts: DataFrame, classes: int, unit_share: int, least_count: int, bucket_bytes: int) -> tuple[Core, DataFrame, int]:
    """The core, the table of words with count and class, and its number of buckets."""
    buckets = 1 + (texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // bucket_bytes
    counts = stored(count_words(texts, buckets), "word-counts")
    core = fit_core(counts, texts, classes, unit_share)
    classed = stored(assign(neighbour_cells(texts, core, buckets), counts, core, least_count), "classed-words")
    discard(counts)
    return core, classed, buckets


def score_documents(docs: DataFrame, held_out: Column, classes: int = 64, unit_share: int = 2000, least_count: int = 10, pull: float = 10.0, bucket_bytes: int = 4 << 20) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), a row for each row of docs."""
    spark = docs.sparkSession
    shared_dir(spark)
    texts = docs.select(F.coalesce("text", F.lit("")).alias("text"), (~held_out).alias("train"), integral(docs, "doc_id"), held_out.alias("held_out"))
    core, classed, buckets = fit_classes(texts, classes, unit_share, least_count, bucket_bytes)
    rows = stored(ask(texts, buckets), "asked")
    answers = stored(answer(rows.where("bucket IS NOT NULL").select("uid", "bucket", "keys"), classed.select("bucket", "keys", "counts", "kinds"), core), "answers")
    documents = stored(read_back(rows.where("bucket IS NULL").select("uid", "places", "sizes", "ids", "held"), answers), "classed")

    class_tokens, class_types = np.zeros(classes), np.zeros(classes)
    per_class = classed.select(F.posexplode(F.arrays_zip("class_tokens", "class_types")).alias("at", "of")).groupBy("at").agg(F.sum("of.class_tokens").alias("tokens"), F.sum("of.class_types").alias("types"))
    for r in per_class.collect():  # a row a class
        class_tokens[r["at"]], class_types[r["at"]] = r["tokens"], r["types"]
    discard(classed, rows, answers)
    table = class_bigrams(documents, classes)
    share = (table.sum(0) + 0.5) / (table.sum() + 0.5 * classes)
    step = (np.log10((table + pull * share) / (table.sum(1, keepdims=True) + pull)) - np.log10(class_tokens + 0.5 * (class_types + 1))).ravel()
    base_total = float(np.log10(core.tokens + 0.5 * (core.types + 1)))

    def run(batches):
        for batch in batches:
            steps = [np.zeros(0)]
            for at in range(0, batch.num_rows, 1000):
                part = batch.column(5).slice(at, 1000)
                doc, pair = _pairs(part, classes)
                steps.append(np.bincount(doc, step[pair], len(part)) if len(doc) else np.zeros(len(part)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(np.concatenate(steps))], names=["doc_id", "held_out", "n_tokens", "n_known", "logs", "steps"])
            tidy()

    own = documents.mapInArrow(run, READ.replace("classes binary", "steps double"))
    return own.select(
        "doc_id",
        "held_out",
        "n_tokens",
        "n_known",
        F.lit(core.tokens).cast("long").alias("train_tokens"),
        (F.col("logs") - F.col("n_tokens") * base_total).alias("base_score"),
        (F.col("logs") + F.col("steps")).alias("score"),
    )


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score_documents(docs, folds(F.col("doc_id"), 5) == 1)
