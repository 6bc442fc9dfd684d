"""Inverted rows: what an Arrow batch of token lists holds, turned round in place, so that a term's documents leave a task as one row and not one row a token.

A posting row has a term, a column, `docs` (ids, or places in a bucket), `counts` (occurrences in each) and `places` (all positions, document after
document).  Both stored indexes are written from such rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

TOKENS = 1 << 20  # turned round at once
BUCKET = 128  # documents


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Where a run of equal keys begins."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for key in keys:
        new[1:] |= key[1:] != key[:-1]
    return np.flatnonzero(new)


def _lists(starts: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(starts, len(values)), pa.int32()), values)


class Pairs:
    """Terms of documents (rows 0, 1, ...): of each pair the term's code, column, row and count, and where its positions begin in `places`."""

    def __init__(self, words: pa.Array, code, col, row, count, start, places):
        self.words, self.code, self.col, self.row, self.count, self.start, self.places = words, code, col, row, count, start, places

    @classmethod
    def of(cls, columns: Sequence[pa.ListArray]) -> Pairs:
        sizes = [np.diff(c.offsets.to_numpy()) for c in columns]
        rows, total = len(columns[0]), sum(int(s.sum()) for s in sizes)
        encoded = pa.concat_arrays([c.flatten() for c in columns]).dictionary_encode()
        code = encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        row = np.concatenate([np.repeat(np.arange(rows), s) for s in sizes])
        col = np.repeat(np.arange(len(columns)), [int(s.sum()) for s in sizes])
        pos = np.concatenate([np.arange(int(s.sum())) - np.repeat(np.cumsum(s) - s, s) for s in sizes])
        key = (code * len(columns) + col) * max(rows, 1) + row
        order = np.argsort(key, kind="stable")
        at = _starts(key[order])
        first = order[at]
        return cls(encoded.dictionary, code[first], col[first], row[first], np.diff(np.append(at, total)), at, pos[order])

    def postings(self, group: np.ndarray, label: pa.Array) -> tuple:
        """(group of each, terms, cols, docs, counts, places): a row for each group of rows, term and column; `label` names the rows."""
        order = np.lexsort((self.row, self.col, self.code, group[self.row]))
        g, code, col, count = group[self.row][order], self.code[order], self.col[order], self.count[order]
        at = _starts(g, code, col)
        out = np.cumsum(count) - count
        flat = self.places[np.repeat(self.start[order] - out, count) + np.arange(int(count.sum()))]
        ends = np.append(out, len(flat))
        return g[at], self.words.take(pa.array(code[at])), col[at], _lists(at, label.take(pa.array(self.row[order]))), _lists(at, pa.array(count, pa.int32())), _lists(ends[at], pa.array(flat, pa.int32()))

    def blocks(self, group: np.ndarray, columns: int, prefixes: int) -> Iterator[tuple]:
        """(kind, group of each, terms, n, most): for each group and term (kind 0) or prefix (kind 1) its rows, and the most occurrences in one of them by column."""
        yield self._counted(0, group, self.words, self.code, np.ones(len(self.code), bool), columns)
        long = pc.utf8_length(self.words).to_numpy(zero_copy_only=False)
        for n in range(1, prefixes + 1):
            cut = pc.utf8_slice_codeunits(self.words, 0, n).dictionary_encode()
            yield self._counted(1, group, cut.dictionary, cut.indices.to_numpy(zero_copy_only=False).astype(np.int64)[self.code], (long >= n)[self.code], columns)

    def _counted(self, kind: int, group: np.ndarray, words: pa.Array, code: np.ndarray, kept: np.ndarray, columns: int) -> tuple:
        row, code, col, count = self.row[kept], code[kept], self.col[kept], self.count[kept]
        key = (group[row] * max(len(words), 1) + code) * max(len(group), 1) + row
        order = np.argsort(key, kind="stable")
        cells = _starts(key[order])
        first = order[cells]
        at = _starts(group[row[first]], code[first])
        n = np.diff(np.append(at, len(first)))
        most = np.zeros((len(at), columns), np.int32)
        for c in range(columns):
            if len(at):
                most[:, c] = np.maximum.reduceat(np.add.reduceat(np.where(col == c, count, 0)[order], cells), at)
        return kind, group[row[first[at]]], words.take(pa.array(code[first[at]])), n, most


def slices(columns: Sequence[pa.ListArray], rows: np.ndarray, step: int) -> Iterator[np.ndarray]:
    """rows in their order, cut after a multiple of `step`, with some TOKENS tokens each (more where `step` rows hold more)."""
    size = sum(np.diff(c.offsets.to_numpy()) for c in columns)[rows].astype(np.int64)
    begin = total = 0
    for end in range(step, len(rows) + step, step):
        total += int(size[end - step : end].sum())
        if total >= TOKENS or end >= len(rows):
            yield rows[begin:end]
            begin, total = end, 0


def by_id(names: Sequence[str]):
    """For mapInArrow over (doc, a token list for each name): (term, col, docs, counts, places), and rows without term and col that hold the lengths of docs as counts."""

    def run(batches):
        for batch in batches:
            ids, columns = batch.column(0), [batch.column(i + 1) for i in range(len(names))]
            for rows in slices(columns, np.arange(len(ids)), 16):
                own, of = [c.take(pa.array(rows)) for c in columns], ids.take(pa.array(rows))
                _, terms, col, docs, counts, places = Pairs.of(own).postings(np.zeros(len(rows), np.int64), of)
                length = pa.array(sum(np.diff(c.offsets.to_numpy()) for c in own), pa.int32())
                yield pa.RecordBatch.from_arrays([terms, pa.array(list(names), pa.string()).take(pa.array(col)), docs, counts, places], names=["term", "col", "docs", "counts", "places"])
                one = np.zeros(1, np.int32)
                yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.string()), pa.nulls(1, pa.string()), _lists(one, of), _lists(one, length), _lists(one, pa.array([], pa.int32()))], names=["term", "col", "docs", "counts", "places"])

    return run


def grams_by_id(names: Sequence[str]):
    """For mapInArrow over (doc, a text for each name): (gram, col, docs), a row for each run of three letters that stands in a slice of a batch."""

    def run(batches):
        for batch in batches:
            for i, name in enumerate(names):
                texts, held, rows = batch.column(i + 1), [], []
                for row, text in enumerate(texts):
                    if text.is_valid:
                        held.append(text.as_py())
                        rows.append(row)
                    if held and (sum(map(len, held[-1:])) >= TOKENS or len(held) >= 1024 or row + 1 == len(texts)):
                        yield _grams(held, batch.column(0).take(pa.array(rows)), name)
                        held, rows = [], []
                if held:
                    yield _grams(held, batch.column(0).take(pa.array(rows)), name)

    return run


def _grams(texts: Sequence[str], ids: pa.Array, name: str) -> pa.RecordBatch:
    letters = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    size = np.array([len(t) for t in texts])
    row = np.repeat(np.arange(len(texts)), size)
    begun = np.flatnonzero(row[2:] == row[:-2]) if len(row) > 2 else np.zeros(0, np.int64)
    key = letters[begun] << 42 | letters[begun + 1] << 21 | letters[begun + 2]
    order = np.argsort(key, kind="stable")
    key, row = key[order], row[begun][order]
    one = _starts(key, row)
    key, row = key[one], row[one]
    at = _starts(key)
    grams = pa.array(["".join(map(chr, (k >> 42, k >> 21 & 0x1FFFFF, k & 0x1FFFFF))) for k in key[at].tolist()], pa.string())
    return pa.RecordBatch.from_arrays([grams, pa.repeat(pa.scalar(name), len(at)), _lists(at, ids.take(pa.array(row)))], names=["gram", "col", "docs"])


def bucket_id(least: int, part: int, no: int) -> int:
    """Ids in order of the least length, unlike within a segment."""
    return min(least, (1 << 20) - 1) << 43 | (part & 0xFFFF) << 27 | (no & 0x7FFFFFF)


STAGED = "what string, term string, kind int, bucket long, col int, n int, most array<int>, least_dl int, docs array<int>, counts array<int>, places array<int>, doc {}, dl int, print string, ord int"
_TYPES = {"kind": pa.int32(), "bucket": pa.int64(), "col": pa.int32(), "n": pa.int32(), "most": pa.list_(pa.int32()), "least_dl": pa.int32(), "docs": pa.list_(pa.int32()), "counts": pa.list_(pa.int32()), "places": pa.list_(pa.int32()), "dl": pa.int32(), "ord": pa.int32()}


def _staged(rows: int, what: str, key: pa.DataType, **given) -> pa.RecordBatch:
    types = {name: _TYPES.get(name, key if name == "doc" else pa.string()) for name in (f.split(" ")[0] for f in STAGED.split(", "))}
    values = {"what": pa.repeat(pa.scalar(what), rows)} | {k: v if isinstance(v, pa.Array) else pa.array(v, types[k]) for k, v in given.items()}
    return pa.RecordBatch.from_arrays([values[k].cast(t) if k in values else pa.nulls(rows, t) for k, t in types.items()], names=list(types))


def staged(pairs: Pairs, group: np.ndarray, ord: np.ndarray, buckets: np.ndarray, least: np.ndarray, columns: int, prefixes: int, doc: pa.Array, dl: np.ndarray, print: pa.Array) -> Iterator[pa.RecordBatch]:
    """The rows of a segment for some whole buckets: `group` is each document's bucket, as a number into `buckets`, and `ord` its place there."""
    g, terms, col, docs, counts, places = pairs.postings(group, pa.array(ord, pa.int32()))
    yield _staged(len(g), "postings", doc.type, term=terms, bucket=buckets[g], col=col, docs=docs, counts=counts, places=places)
    for kind, g, terms, n, most in pairs.blocks(group, columns, prefixes):
        lists = _lists(np.arange(len(g)) * columns, pa.array(most.ravel(), pa.int32()))
        yield _staged(len(g), "blocks", doc.type, term=terms, kind=np.full(len(g), kind), bucket=buckets[g], n=n, most=lists, least_dl=least[g])
    yield _staged(len(doc), "lengths", doc.type, bucket=buckets[group], doc=doc, dl=dl, print=print, ord=ord)


def by_bucket(columns: int, prefixes: int):
    """For mapInArrow over (doc, print, a token list a column): documents of a batch in order of length, BUCKET to a bucket."""

    def run(batches):
        from pyspark import TaskContext

        part, no = TaskContext.get().partitionId(), 0
        for batch in batches:
            lists = [batch.column(i + 2) for i in range(columns)]
            dl = sum(np.diff(c.offsets.to_numpy()) for c in lists)
            for rows in slices(lists, np.argsort(dl, kind="stable"), BUCKET):
                take = pa.array(rows)
                group, ord = np.arange(len(rows)) // BUCKET, np.arange(len(rows)) % BUCKET
                least = dl[rows[::BUCKET]]
                buckets = np.array([bucket_id(int(x), part, no + i) for i, x in enumerate(least)], np.int64)
                no += len(least)
                yield from staged(Pairs.of([c.take(take) for c in lists]), group, ord, buckets, least, columns, prefixes, batch.column(0).take(take), dl[rows], batch.column(1).take(take))

    return run


def _flat(postings: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    """The lists of a column end to end, and their sizes."""
    lists = postings.column(name).combine_chunks()
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.diff(lists.offsets.to_numpy())


def moved(columns: int, prefixes: int):
    """For cogrouped posting rows (term, seg, bucket, col, docs, counts, places) of some old buckets and their live documents (fresh, seg, bucket, ord, doc, dl, print): the rows of one new bucket."""

    def run(postings: pa.Table, live: pa.Table) -> pa.Table:
        live = live.sort_by([("dl", "ascending"), ("doc", "ascending")])
        named = {(s, b, o): i for i, (s, b, o) in enumerate(zip(*(live.column(c).to_pylist() for c in ("seg", "bucket", "ord")), strict=True))}
        docs, size = _flat(postings, "docs")
        counts, (places, _) = _flat(postings, "counts")[0], _flat(postings, "places")
        chunk = np.repeat(np.arange(len(size)), size)
        # A lookup of BUCKET places for each old bucket that stands in the rows.
        pair = pa.StructArray.from_arrays([postings.column(c).combine_chunks() for c in ("seg", "bucket")], names=["seg", "bucket"])
        olds: dict = {}
        of = np.array([olds.setdefault((p["seg"], p["bucket"]), len(olds)) for p in pair.to_pylist()], np.int64)
        width = 1 + max((o for _, _, o in named), default=0)
        to = np.full((len(olds) + 1, max(width, int(docs.max(initial=0)) + 1)), -1, np.int64)
        for (s, b, o), i in named.items():
            if (s, b) in olds:
                to[olds[s, b], o] = i
        row = to[of[chunk], docs] if len(docs) else docs
        kept = row >= 0
        terms = postings.column("term").combine_chunks().dictionary_encode()
        code = terms.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        col = postings.column("col").to_numpy().astype(np.int64)
        start = np.cumsum(counts) - counts
        pairs = Pairs(terms.dictionary, code[chunk][kept], col[chunk][kept], row[kept], counts[kept], start[kept], places)
        n, dl = len(live), live.column("dl").to_numpy()
        doc, print = (live.column(c).combine_chunks() for c in ("doc", "print"))
        batches = staged(pairs, np.zeros(n, np.int64), np.arange(n), live.column("fresh").to_numpy()[:1], dl[:1], columns, prefixes, doc, dl, print) if n else ()
        return pa.Table.from_batches(list(batches), schema=_staged(0, "", doc.type).schema)

    return run


def lost(prefixes: int):
    """For posting rows (seg, bucket, term, docs) of one bucket, with the documents that went: (seg, term, kind, n), how many held a term or prefix."""

    def run(postings: pa.Table) -> pa.Table:
        docs, size = _flat(postings, "docs")
        terms = postings.column("term").combine_chunks().dictionary_encode()
        code = np.repeat(terms.indices.to_numpy(zero_copy_only=False).astype(np.int64), size)
        one = np.ones(len(docs), np.int64)
        pairs = Pairs(terms.dictionary, code, one * 0, docs, one, one, one)
        out = []
        for kind, _, words, n, _ in pairs.blocks(np.zeros(int(docs.max(initial=0)) + 1, np.int64), 1, prefixes):
            seg = pa.repeat(postings.column("seg")[0].cast(pa.int32()), len(words))
            out.append(pa.RecordBatch.from_arrays([seg, words, pa.repeat(pa.scalar(kind, pa.int32()), len(words)), pa.array(n, pa.int64())], names=["seg", "term", "kind", "n"]))
        return pa.Table.from_batches(out)

    return run


def packed():
    """For mapInArrow over old buckets (seg, bucket, least, n) in order of length: (fresh, seg, bucket), neighbours joined until a new bucket has BUCKET documents."""

    def run(batches):
        from pyspark import TaskContext

        part, no, held, fresh = TaskContext.get().partitionId(), 0, BUCKET, 0
        for batch in batches:
            out = []
            for seg, bucket, least, n in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if held + n > BUCKET:
                    fresh, no, held = bucket_id(least, part, no), no + 1, 0
                held += n
                out.append((fresh, seg, bucket))
            kinds = (pa.int64(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], kind) for i, kind in enumerate(kinds)], names=["fresh", "seg", "bucket"])

    return run
