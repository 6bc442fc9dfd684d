"""Quality rules: gradient-boosted trees over document statistics, scored from flat numpy node arrays.

`statistics` reads whole texts in vectorised blocks.  `fit_trees` boosts shallow histogram trees on logistic loss; features listed
in MONOTONE may only move the score one way: a split that breaks the order is refused, and the bounds of a constrained split hold
for everything below it.  All trees of a model have one depth and lie in arrays by heap number, so a score is `depth` gathers a tree.

Training labels are a bounded sample: the `sample_rows` labelled documents of the smallest id hash, so its size does not
depend on the corpus.  Everything else covers all rows and whole texts.

Defined cases: a null or empty text has no words and fails the base rules; null ids are kept; a document labelled twice is used once per label row;
without labels, or with labels of one class only, the model is the prior and the base rules decide; repeated rows are judged alike; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import textkit as tk
from lodestone.llm.common import annotate, table

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
_STARTS = (np.arange(256) & 0xC0) != 0x80
_UPPER = np.zeros(256, bool)
_UPPER[ord("A") : ord("Z") + 1] = True
_LETTER = _UPPER.copy()
_LETTER[ord("a") : ord("z") + 1] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[ord("0") : ord("9") + 1] = True
_MARK = np.zeros(256, bool)
_MARK[list(b"!?")] = True

FEATURES = ("log_words", "mean_word", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "digit_share", "mark_share", "distinct_share", "words_a_line", "twin_share")
#: -1: the score may not rise with the feature.
MONOTONE = {"symbol_share": -1, "dup_line_share": -1, "repeat_share": -1, "upper_share": -1, "mark_share": -1, "twin_share": -1}
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def statistics(column: pa.Array, window: int = 8, block_bytes: int = tk.BLOCK_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """Base counts (a column for each of BASE) and features (one for each of FEATURES), a row for each text."""
    base, features = [np.zeros((0, len(BASE)), np.int64)], [np.zeros((0, len(FEATURES)))]
    for block in tk.blocks(column, block_bytes):
        data = block.data
        found = tk.words(block)
        n_words = found.counts
        word_chars = block.per_doc(tk.NOT_SPACE[data] & _STARTS[data])
        symbols = block.per_doc(SYMBOLS[data])

        lines = tk.lines(block)
        line_words = np.searchsorted(found.starts, lines.ends) - np.searchsorted(found.starts, lines.starts)
        full = line_words > 0
        salted = tk.mix(lines.hashes[full] + lines.doc[full].astype(tk.U) * tk.U(0x9E3779B97F4A7C15))
        kept_doc = lines.doc[full]
        firsts = np.unique(salted, return_index=True)[1]
        n_lines = np.bincount(kept_doc, minlength=block.n)
        dup_lines = n_lines - np.bincount(kept_doc[firsts], minlength=block.n)

        keys, at = tk.windows(found.hashes, found.first, window)
        keys = tk.mix(keys + found.doc[at].astype(tk.U) * tk.U(0x9E3779B97F4A7C15))
        order = np.argsort(keys)
        ordered = keys[order]
        equal = np.zeros(len(keys), bool)
        if len(keys) > 1:
            near = ordered[1:] == ordered[:-1]
            equal[1:] |= near
            equal[:-1] |= near
        repeats = np.bincount(found.doc, weights=tk.covered(len(found.doc), at[order[equal]], window), minlength=block.n).astype(np.int64)

        own = tk.mix(found.hashes + found.doc.astype(tk.U) * tk.U(0xD6E8FEB86659FD93))
        distinct = np.bincount(found.doc[np.unique(own, return_index=True)[1]], minlength=block.n)
        twins = np.bincount(found.doc[1:][(found.hashes[1:] == found.hashes[:-1]) & (found.doc[1:] == found.doc[:-1])], minlength=block.n) if len(own) else np.zeros(block.n)

        w, c, letters = np.maximum(n_words, 1), np.maximum(word_chars, 1), np.maximum(block.per_doc(_LETTER[data]), 1)
        base.append(np.stack([n_words, word_chars, symbols, dup_lines, repeats], 1))
        features.append(np.stack([
            np.log2(n_words + 1), word_chars / w, symbols / w, dup_lines / np.maximum(n_lines, 1), repeats / w,
            block.per_doc(_UPPER[data]) / letters, block.per_doc(_DIGIT[data]) / c, block.per_doc(_MARK[data]) / w, distinct / w, n_words / np.maximum(n_lines, 1), twins / w,
        ], 1))
    return np.concatenate(base), np.concatenate(features)


@dataclass
class Trees:
    """Heap-ordered nodes: children of node i are 2i + 1 and 2i + 2; the last level holds leaf values."""

    prior: float
    feature: np.ndarray  # trees x inner nodes
    threshold: np.ndarray
    value: np.ndarray  # trees x leaves
    depth: int

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.prior)
        rows = np.arange(len(x))
        for feature, threshold, value in zip(self.feature, self.threshold, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            out += value[node - len(feature)]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -30, 30)))


def fit_trees(x: np.ndarray, y: np.ndarray, monotone: Sequence[int], n_trees: int = 40, depth: int = 3, rate: float = 0.2, bins: int = 48, ridge: float = 1.0, least: float = 2.0) -> Trees:
    """Second-order boosting of logistic loss over quantile bins; `least` is the smallest hessian of a child."""
    inner = 2**depth - 1
    mean = float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3))
    model = Trees(float(np.log(mean / (1 - mean))), np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)), depth)
    if len(np.unique(y)) < 2:
        return model
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], 1)
    raw = np.full(len(x), model.prior)
    all_feature, all_threshold, all_value = [], [], []
    for _ in range(n_trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = y - p, p * (1 - p)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        bounds = [(-np.inf, np.inf)] * (2 * inner + 1)
        node = np.zeros(len(x), np.int64)
        for i in range(inner):
            own = np.flatnonzero(node == i)
            low, high = bounds[i]
            best, split = 1e-6, None
            if len(own):
                whole_g, whole_h = g[own].sum(), h[own].sum()
                gain_of = lambda a, b: a * a / (b + ridge)
                for j, c in enumerate(cuts):
                    if not len(c):
                        continue
                    left_g = np.cumsum(np.bincount(binned[own, j], g[own], len(c) + 1))[:-1]
                    left_h = np.cumsum(np.bincount(binned[own, j], h[own], len(c) + 1))[:-1]
                    lv, rv = left_g / (left_h + ridge), (whole_g - left_g) / (whole_h - left_h + ridge)
                    gain = gain_of(left_g, left_h) + gain_of(whole_g - left_g, whole_h - left_h) - gain_of(whole_g, whole_h)
                    gain[(left_h < least) | (whole_h - left_h < least)] = -1
                    if monotone[j]:
                        gain[(np.clip(rv, low, high) - np.clip(lv, low, high)) * monotone[j] < 0] = -1
                    k = int(np.argmax(gain))
                    if gain[k] > best:
                        best, split = gain[k], (j, k, float(np.clip(lv[k], low, high)), float(np.clip(rv[k], low, high)))
            bounds[2 * i + 1] = bounds[2 * i + 2] = (low, high)
            if split:
                j, k, lv, rv = split
                feature[i], threshold[i] = j, cuts[j][k]
                if monotone[j]:
                    middle = (lv + rv) / 2
                    bounds[2 * i + 1], bounds[2 * i + 2] = ((low, middle), (middle, high)) if monotone[j] > 0 else ((middle, high), (low, middle))
            node[own] = 2 * i + 1 + (x[own, feature[i]] > threshold[i])
        leaf = node - inner
        sums_g, sums_h = np.bincount(leaf, g, inner + 1), np.bincount(leaf, h, inner + 1)
        value = sums_g / (sums_h + ridge)
        for k in range(inner + 1):
            value[k] = np.clip(value[k], *bounds[inner + k])
        raw += rate * value[leaf]
        all_feature.append(feature)
        all_threshold.append(threshold)
        all_value.append(rate * value)
    return Trees(model.prior, np.stack(all_feature), np.stack(all_threshold), np.stack(all_value), depth)


def labelled_sample(docs: DataFrame, labels: DataFrame, sample_rows: int, label: str = "quality") -> DataFrame:
    """(label, text) of at most sample_rows labelled documents, those of the smallest id hash."""
    chosen = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).cast("int").alias("label"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(sample_rows)
    # Bounded by sample_rows, so it may be broadcast.
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "label", "text")


def fit_quality(docs: DataFrame, labels: DataFrame, sample_rows: int = 6000) -> Trees:
    def scan(column: pa.Array, row: pa.StructArray) -> list[pa.Array]:
        _, features = statistics(column)
        return [pa.array(list(features), pa.list_(pa.float64()))]

    rows = annotate(labelled_sample(docs, labels, sample_rows), scan, "features array<double>", keep=("doc_id", "label")).select("row.doc_id", "row.label", "features").toPandas()
    rows = rows.sort_values(["doc_id", "label"])
    x = np.array(rows["features"].tolist()).reshape(-1, len(FEATURES))
    return fit_trees(x, rows["label"].to_numpy(float), [MONOTONE.get(f, 0) for f in FEATURES])


def judge(docs: DataFrame, model: Trees, keep: Sequence[str] = ("doc_id",), least_score: float = 0.3) -> DataFrame:
    """row (struct of the kept columns), text, the base counts, base_failed, score, kept."""

    def scan(column: pa.Array, row: pa.StructArray) -> list[pa.Array]:
        base, features = statistics(column)
        failed = (base[:, 0] < 20) | (100 * base[:, 4] > 30 * base[:, 0])
        score = model.score(features)
        return [*(pa.array(base[:, j]) for j in range(len(BASE))), pa.array(failed), pa.array(score), pa.array(~failed & (score >= least_score))]

    return annotate(docs, scan, ", ".join(f"{b} long" for b in BASE) + ", base_failed boolean, score double, kept boolean", keep=keep)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return judge(docs, fit_quality(docs, table(spark, sf_dir, "labels"))).select("row.doc_id", *BASE, "base_failed", "score", "kept")
