"""Vectorised word, line and window primitives over Arrow text columns.

A block is a run of documents whose bytes lie back to back in one numpy array.  Words are found by a byte table, and
get a 64-bit hash by mixing eight bytes a step, so no Python object is made for a word.  Equal bytes give equal hashes.
Unequal spans of one length up to eight bytes never collide; others do with a chance of about 2**-64 a pair, whatever their structure.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa

U = np.uint64
BLOCK_BYTES = 1 << 19

LONG_SPAN = 128

_Q = U(0x9E3779B97F4A7C15)
_S = U(0xD6E8FEB86659FD93)
_TAIL = np.array([(1 << 8 * i) - 1 for i in range(9)], U)

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
NOT_SPACE = ~SPACE
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a text column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


@dataclass
class Block:
    """Documents first .. first + n - 1 of a batch; offsets start at 0."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    @property
    def n(self) -> int:
        return len(self.offsets) - 1

    def per_doc(self, flags: np.ndarray) -> np.ndarray:
        """How many bytes of each document are flagged."""
        total = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=total[1:])
        return total[self.offsets[1:]] - total[self.offsets[:-1]]


def blocks(column: pa.Array, size: int = BLOCK_BYTES) -> Iterator[Block]:
    """Splits a column at document borders into blocks of about `size` bytes; a longer document is a block of its own."""
    data, offsets = utf8(column)
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        yield Block(at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
        at = to


@dataclass
class Words:
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray  # of each document: the index of its first word, and behind the last document the count
    doc: np.ndarray  # of each word
    hashes: np.ndarray | None = None

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of the bytes of each span: eight bytes a step, each step a bijection of all 64 bits, so that no algebra of the text makes spans collide.
    Spans above LONG_SPAN bytes get a BLAKE2b digest instead of many steps over few spans."""
    size = ends - starts
    out = size.astype(U) * _S
    loads = np.ndarray(len(data) + 1, "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))
    on = np.flatnonzero(size <= LONG_SPAN)
    at, left = starts[on], size[on]
    while len(on):
        out[on] = mix((out[on] ^ (loads[at] & _TAIL[np.minimum(left, 8)])) * _Q + _S)
        more = left > 8
        on, at, left = on[more], at[more] + 8, left[more] - 8
    for i in np.flatnonzero(size > LONG_SPAN):
        out[i] = int.from_bytes(blake2b(data[starts[i] : ends[i]], digest_size=8).digest(), "little")
    return out


def words(block: Block, is_word: np.ndarray = NOT_SPACE, hashed: bool = True, data: np.ndarray | None = None) -> Words:
    """Maximal runs of word bytes that stay inside a document."""
    data = block.data if data is None else data
    flags = is_word[data]
    n = len(flags)
    cuts = block.offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < n)]
    begins, ends = flags.copy(), flags.copy()
    if n:
        begins[1:] &= ~flags[:-1]
        begins[cuts] = flags[cuts]
        ends[:-1] &= ~flags[1:]
        ends[cuts - 1] = flags[cuts - 1]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    first = np.searchsorted(starts, block.offsets)
    doc = np.repeat(np.arange(block.n), np.diff(first))
    return Words(starts, stops, first, doc, span_hash(data, starts, stops) if hashed else None)


def lines(block: Block) -> Words:
    """The \\n-split lines of each document; a document has one line more than line ends."""
    breaks = np.flatnonzero(block.data == 10)
    per = np.searchsorted(breaks, block.offsets)
    count = np.diff(per) + 1
    first = np.concatenate([[0], np.cumsum(count)])
    starts = np.empty(first[-1], np.int64)
    ends = np.empty(first[-1], np.int64)
    is_first = np.zeros(first[-1], bool)
    is_first[first[:-1]] = True
    is_last = np.zeros(first[-1], bool)
    is_last[first[1:] - 1] = True
    starts[is_first], starts[~is_first] = block.offsets[:-1], breaks + 1
    ends[is_last], ends[~is_last] = block.offsets[1:], breaks
    return Words(starts, ends, first, np.repeat(np.arange(block.n), count), span_hash(block.data, starts, ends))


def windows(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and index of the first word of every window of k words inside one document."""
    if len(hashes) < k:
        return np.zeros(0, U), np.zeros(0, np.int64)
    n = len(hashes) - k + 1
    out = hashes[:n].copy()
    for j in range(1, k):
        out ^= out >> U(32)
        out *= _Q
        out += hashes[j : j + n]
    whole = np.ones(n, bool)
    borders = first[1:-1]
    for j in range(1, k):  # a window that starts j words before a border crosses it
        at = borders - j
        whole[at[(at >= 0) & (at < n)]] = False
    at = np.flatnonzero(whole)
    return mix(out[at]), at


def covered(n: int, at: np.ndarray, k) -> np.ndarray:
    """Which of n words lie in a window of k words that starts at one of the given indices; k may be an array."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, at, 1)
    np.add.at(steps, np.minimum(at + k, n), -1)
    return np.cumsum(steps[:-1]) > 0


def sum_by(index: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(index, weights=values, minlength=n)


def column_of(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))
