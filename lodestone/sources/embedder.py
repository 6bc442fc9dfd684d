"""Embedding behind an Arrow boundary: any provider that maps texts to vectors; a deterministic hashing one is built in."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Provider = Callable[[Sequence[str], int], np.ndarray]


def hash_provider(texts: Sequence[str], dims: int) -> np.ndarray:
    """Signed feature hashing of words, unit length; empty texts are zero vectors."""
    out = np.zeros((len(texts), dims), np.float32)
    for i, text in enumerate(texts):
        for word in text.split():
            h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
            out[i, h % dims] += 1.0 if h >> 63 else -1.0
    norms = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, norms, out=out, where=norms > 0)


def with_retries(provider: Provider, tries: int = 3, wait: float = 0.25, most: float = 2.0) -> Provider:
    """Repeats failed calls with doubling waits."""

    def call(texts: Sequence[str], dims: int) -> np.ndarray:
        for n in range(tries):
            try:
                return provider(texts, dims)
            except (OSError, TimeoutError):
                if n + 1 == tries:
                    raise
                time.sleep(min(most, wait * 2**n))
        raise AssertionError

    return call


def embed(rows: DataFrame, key: str, text: str, dims: int, provider: Provider = hash_provider, batch: int = 100) -> DataFrame:
    """(key, embedding) of every row, in batches; a provider that returns another width is an error."""

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, batch):
                part = b.slice(at, batch)
                made = provider([x or "" for x in part.column(1).to_pylist()], dims)
                if made.shape != (part.num_rows, dims):
                    raise ValueError(f"expected {part.num_rows} vectors of width {dims}, got shape {made.shape}")
                flat = pa.array(np.ascontiguousarray(made, np.float32).reshape(-1))
                offsets = pa.array(np.arange(0, part.num_rows * dims + 1, dims, dtype=np.int32))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(offsets, flat)], names=[key, "embedding"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(F.col(key), F.col(text)).mapInArrow(run, f"{key} {kind}, embedding array<float>")


class BreakerOpenError(RuntimeError):
    """Calls are refused until the breaker closes."""


def with_breaker(provider: Provider, seconds: float = 30.0, clock: Callable[[], float] = time.monotonic) -> Provider:
    """After a failed call, refuses all calls for some seconds instead of waiting for each to fail."""
    until = [float("-inf")]

    def call(texts: Sequence[str], dims: int) -> np.ndarray:
        if clock() < until[0]:
            raise BreakerOpenError(f"closed again in {until[0] - clock():.0f} s")
        try:
            return provider(texts, dims)
        except (OSError, TimeoutError):
            until[0] = clock() + seconds
            raise

    return call


#: Widths that providers offer.
WIDTHS = (128, 256, 512, 768, 1024, 1536, 2048, 3072)


def choose(prefer: str | None, hosted: Provider | None, local: Provider | None, dims: int) -> tuple[str, Provider] | None:
    """(name, provider): local if preferred and there, else hosted, else local, else none."""
    if dims not in WIDTHS:
        raise ValueError(f"width {dims} is none of {WIDTHS}")
    order = [("local", local), ("hosted", hosted)] if (prefer or "").strip().lower() == "local" else [("hosted", hosted), ("local", local)]
    return next(((name, p) for name, p in order if p is not None), None)
