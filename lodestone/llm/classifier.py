"""Quality classifier: logistic regression over hashed word n-grams, trained with FTRL-proximal updates.

Features of a text are its words and word pairs, and the same over word shapes (runs of capitals, small letters, digits and each
mark collapsed), hashed into 2**bits slots; a pair of equal words takes one common slot.  Values are counts over the square root of the document's
number of n-grams.  Training sees a bounded sample (`sample_rows` labelled documents of the smallest id hash outside the
held-out fold) in a fixed order, one FTRL step a document; scoring is one sparse dot product a document over whole texts.

Defined cases: a null or empty text has no features and scores the bias alone; rows without an id are in the fold of the empty id; rows whose
label is null are not learnt from; without labels the score is 0.5; repeated rows score alike; only doc_id and text are read of the documents.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import textkit as tk
from lodestone.llm.common import annotate, folds, table
from lodestone.llm.quality import labelled_sample

_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[ord("a") : ord("z") + 1] = ord("a")
_CLASS[0x80:] = ord("a")
_CLASS[ord("A") : ord("Z") + 1] = ord("A")
_CLASS[ord("0") : ord("9") + 1] = ord("0")


def features(block: tk.Block, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, slot, number of n-grams of each document)."""
    found = tk.words(block)
    n = len(found.hashes)
    shape = _CLASS[block.data]
    turns = np.ones(len(shape), bool)
    turns[1:] = shape[1:] != shape[:-1]
    turns[found.starts] = True
    kept = np.flatnonzero(turns)
    shapes = tk.span_hash(shape[kept], np.searchsorted(kept, found.starts), np.searchsorted(kept, found.ends))
    pair = np.flatnonzero(found.doc[1:] == found.doc[:-1]) if n else np.zeros(0, np.int64)
    salt, q = tk.U(0x9E3779B97F4A7C15), tk.U(0xD6E8FEB86659FD93)
    pairs = np.where(found.hashes[pair] == found.hashes[pair + 1], salt, found.hashes[pair] * salt + found.hashes[pair + 1])
    slots = np.concatenate([found.hashes, tk.mix(pairs), tk.mix(shapes ^ q), tk.mix((shapes[pair] * q + shapes[pair + 1]) ^ salt)])
    doc = np.concatenate([found.doc, found.doc[pair], found.doc, found.doc[pair]])
    return doc, (slots >> tk.U(64 - bits)).astype(np.int64), np.bincount(doc, minlength=block.n)


class Ftrl:
    """Per-coordinate FTRL-proximal for logistic loss; the last slot is the bias."""

    def __init__(self, bits: int, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.05, l2: float = 0.1):
        self.z, self.n = np.zeros(2**bits + 1), np.zeros(2**bits + 1)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, x: np.ndarray, y: float) -> None:
        w = self.weights(at)
        g = (1 / (1 + np.exp(-np.clip(w @ x, -30, 30))) - y) * x
        self.z[at] += g - (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha * w
        self.n[at] += g * g


def fit_classifier(docs: DataFrame, labels: DataFrame, label: str = "quality", bits: int = 18, sample_rows: int = 6000, passes: int = 3) -> np.ndarray:
    """Weights: 2**bits slots, then the bias.  labels must hold training rows only."""

    def scan(column: pa.Array, row: pa.StructArray) -> list[pa.Array]:
        slots, values = [], []
        for block in tk.blocks(column):
            doc, slot, total = features(block, bits)
            keys, counts = np.unique(doc * 2**bits + slot, return_counts=True)
            cuts = np.searchsorted(keys, np.arange(1, block.n) * 2**bits)
            slots += np.split((keys % 2**bits).astype(np.int32), cuts)
            values += [c / np.sqrt(max(1, t)) for c, t in zip(np.split(counts, cuts), total, strict=True)]
        return [pa.array([s.tobytes() for s in slots], pa.binary()), pa.array([v.astype(np.float32).tobytes() for v in values], pa.binary())]

    rows = annotate(labelled_sample(docs, labels, sample_rows, label), scan, "slots binary, x binary", keep=("doc_id", "label")).select("row.doc_id", "row.label", "slots", "x").toPandas()
    rows = rows.sort_values(["doc_id", "label"]).reset_index(drop=True)
    model = Ftrl(bits)
    order = np.random.default_rng(5)
    for _ in range(passes):
        for i in order.permutation(len(rows)):
            at = np.append(np.frombuffer(rows["slots"][i], np.int32), 2**bits)
            model.learn(at, np.append(np.frombuffer(rows["x"][i], np.float32), 1.0).astype(float), float(rows["label"][i]))
    return model.weights()


def score_documents(docs: DataFrame, weights: np.ndarray, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """row (struct of the kept columns) and score."""
    bits = int(len(weights) - 1).bit_length() - 1
    packed = weights.astype(np.float32)

    def scan(column: pa.Array, row: pa.StructArray) -> list[pa.Array]:
        out = [np.zeros(0)]
        for block in tk.blocks(column):
            doc, slot, total = features(block, bits)
            dot = np.bincount(doc, weights=packed[slot], minlength=block.n) / np.sqrt(np.maximum(total, 1)) + packed[-1]
            out.append(1 / (1 + np.exp(-np.clip(dot, -30, 30))))
        return [pa.array(np.concatenate(out))]

    return annotate(docs, scan, "score double", keep=keep)


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    weights = fit_classifier(docs, labels.where(folds(F.col("doc_id"), 5) != 0))
    scored = score_documents(docs, weights).select("row.doc_id", "score")
    return scored.select("doc_id", (folds(F.col("doc_id"), 5) == 0).alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))
