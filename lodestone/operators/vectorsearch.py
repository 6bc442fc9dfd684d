"""Exact vector search: filters before top-k, norms computed once, widths guarded."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lodestone.functions import vectors as V


_ROWS = 1024  # rows that meet a block of queries at once


def with_norms(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """Rows with a usable vector, its norm and its width."""
    return rows.where(F.col(vector).isNotNull() & (F.size(vector) > 0)).withColumn("norm", V.norm(F.col(vector))).withColumn("dims", F.size(vector))


def similar(rows: DataFrame, query: Sequence[float], vector: str = "embedding", where: Column | None = None) -> DataFrame:
    kept = rows if where is None else rows.where(where)
    q = V.vector_literal(query)
    size = float(sum(x * x for x in query)) ** 0.5
    return kept.withColumn("sim", V.cosine(F.col(vector), q, norm_b=F.lit(size)))


def nearest(rows: DataFrame, query: Sequence[float], key: str, k: int, vector: str = "embedding", where: Column | None = None, floor: float | None = None) -> DataFrame:
    found = similar(rows, query, vector, where)
    if floor is not None:
        found = found.where(F.col("sim") >= floor)
    return found.orderBy(F.col("sim").desc(), key).limit(k)


def nearest_by_row(rows: DataFrame, queries: DataFrame, key: str, k: int, vector: str = "embedding", block: int = 1024) -> DataFrame:
    """(qid, key, sim, place): the best k rows for each query row (qid, qvec), a query itself left out where qid is the key.

    Queries are taken in blocks of `block` vectors, so that what a task holds is bounded; _ROWS rows meet a block in one matrix product, and a task holds and gives out its own best k.
    """
    kind, number, found = rows.schema[key].dataType.simpleString(), queries.schema["qid"].dataType.simpleString(), None
    schema = f"qid {number}, {key} {kind}, sim double"
    of_query = to_arrow_type(queries.schema["qid"].dataType)
    held: list = []

    def scan(part: list) -> DataFrame:
        by_width: dict[int, tuple[list, np.ndarray]] = {}
        for width in {len(v) for _, v in part}:
            own = [(q, v) for q, v in part if len(v) == width]
            by_width[width] = ([q for q, _ in own], unit_rows(np.array([v for _, v in own], np.float64)))

        def run(batches):
            held = {width: None for width in by_width}  # the best of the task so far: query numbers, keys, similarities
            for whole in batches:
                for batch in (whole.slice(i, _ROWS) for i in range(0, len(whole), _ROWS)):
                    vectors = batch.column(1)
                    size = np.diff(vectors.offsets.to_numpy())
                    flat, starts = vectors.values.to_numpy(zero_copy_only=False), vectors.offsets.to_numpy()
                    for width, (_, matrix) in by_width.items():
                        at = np.flatnonzero((size == width) & ~vectors.is_null().to_numpy(zero_copy_only=False))
                        if not len(at) or not width:
                            continue
                        sims = np.round(unit_rows(flat[starts[at, None] + np.arange(width)].astype(np.float64)) @ matrix.T, 12)  # so that equal ones tie
                        n = min(k + 1, len(at))
                        least = np.partition(sims, len(at) - n, axis=0)[len(at) - n]
                        row, of = np.nonzero(sims >= least)  # ties come along; the order over all batches decides
                        held[width] = _best(held[width], of, batch.column(0).take(pa.array(at[row])), sims[row, of], k + 1)
            for width, best in held.items():
                if best is not None:
                    of, ids, sims = best
                    yield pa.RecordBatch.from_arrays([pa.array(by_width[width][0], of_query).take(pa.array(of)), ids, pa.array(sims)], names=["qid", key, "sim"])

        return rows.where(F.col(vector).isNotNull()).select(key, F.col(vector).cast("array<float>").alias("v")).mapInArrow(run, schema)

    for r in queries.select("qid", "qvec").where("qvec IS NOT NULL").toLocalIterator():
        held.append((r["qid"], r["qvec"]))
        if len(held) == block:
            found = scan(held) if found is None else found.unionByName(scan(held))
            held = []
    if held or found is None:
        found = scan(held) if found is None else found.unionByName(scan(held))
    ranked = found.where(F.col("qid") != F.col(key)).withColumn("place", F.row_number().over(Window.partitionBy("qid").orderBy(F.col("sim").desc(), key)))
    return ranked.where(F.col("place") <= k)


def _best(held: tuple | None, of: np.ndarray, ids: pa.Array, sims: np.ndarray, k: int) -> tuple:
    """(query number, key, similarity) of what was held and what comes, without what is below the k-th similarity of its query."""
    if held is not None:
        of, ids, sims = np.concatenate([held[0], of]), pa.concat_arrays([held[1], ids]), np.concatenate([held[2], sims])
    order = np.lexsort((-sims, of))
    of, sims = of[order], sims[order]
    first = np.flatnonzero(np.append(True, of[1:] != of[:-1])) if len(of) else np.zeros(0, np.int64)
    size = np.diff(np.append(first, len(of)))
    least = np.repeat(sims[np.minimum(first + k, first + size) - 1], size) if len(of) else sims
    kept = sims >= least
    return of[kept], ids.take(pa.array(order[kept])), sims[kept]


def unit_rows(matrix: np.ndarray) -> np.ndarray:
    """Rows of length 1; zero rows stay zero, so that their similarity is 0."""
    size = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, size, out=np.zeros_like(matrix), where=size > 0)


def margins(ranked: DataFrame) -> DataFrame:
    """One row from (qid, sim, relevant): how near the best relevant and the best other result of a query are, on average, and the mean difference."""
    per = ranked.groupBy("qid").agg(F.max(F.when(F.col("relevant"), F.col("sim"))).alias("target"), F.max(F.when(~F.col("relevant"), F.col("sim"))).alias("distractor"))
    return per.agg(F.avg("target").alias("target"), F.avg("distractor").alias("distractor"), F.avg(F.col("target") - F.col("distractor")).alias("margin"))


def width_histogram(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    return rows.groupBy(F.coalesce(F.size(vector), F.lit(-1)).alias("dims")).agg(F.count("*").alias("n"))


def missing_vectors(rows: DataFrame, vectors: DataFrame, key: str, vector_key: str) -> DataFrame:
    return rows.join(vectors.select(F.col(vector_key).alias(key)), key, "left_anti")


def embed_text(title: Column, kind: Column, framework: Column, abstract: Column) -> Column:
    return F.when(F.trim(F.coalesce(abstract, F.lit(""))) != "", F.trim(abstract)).otherwise(F.concat(title, F.lit(" — "), kind, F.lit(" in "), framework, F.lit(".")))


def prompt_query(text: Column, task: str = "search result") -> Column:
    return F.when(text.startswith("task: "), text).otherwise(F.concat(F.lit(f"task: {task} | query: "), text))


def prompt_document(title: Column, text: Column) -> Column:
    return F.when(text.startswith("title: "), text).otherwise(F.concat(F.lit("title: "), title, F.lit(" | text: "), text))


def plain_id(identifier: Column) -> Column:
    return F.regexp_replace(identifier, "^sym-", "")


def retrieval_quality(ranks: DataFrame, cuts: Sequence[int] = (1, 3, 5)) -> DataFrame:
    """One row: mean reciprocal rank and recall at each cut, from (rank) of the first relevant result of each query."""
    return ranks.agg(F.count("*").alias("queries"), F.avg(1 / F.col("rank")).alias("mrr"), *(F.avg((F.col("rank") <= c).cast("double")).alias(f"recall_{c}") for c in cuts))
