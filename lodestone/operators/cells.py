"""Exact nearest neighbours for many queries from a stored index of cells: pruned by the triangle inequality on angles, so nothing is lost.

A row belongs to the cell of the centroid nearest by angle, and the index keeps that angle.  A cell's rows lie in chunks in order of it, about
a megabyte each.  A query that is at angle t from a centroid, and knows k rows within angle r, needs only chunks whose angles reach into [t - r, t + r]:
any other row is farther than r.  Queries are grouped by their own cell into blocks; a block first meets its cell, which gives r, then the
chunks of other cells that r reaches.  So a task holds one block and one chunk at a time.

Centroids are fitted on a bounded sample (`sample` rows of the smallest key hashes); every row is indexed.  Rows of unlike widths never meet;
zero vectors are a cell of their own that every block meets; null and empty vectors are left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.operators.vectorsearch import _ROWS, unit_rows
from lodestone.sources.catalog import bounded_batches, ensure_checkpoint_dir

_SLACK = 1e-6  # radians, above the error of an angle
_BLOCK_SHIFT = 8  # queries of a block: 2 ** 8


def centroids(rows: DataFrame, key: str, vector: str, cells: int, sample: int, sweeps: int = 8) -> dict[int, np.ndarray]:
    """Unit centroids by width, from spherical k-means over a bounded sample of the non-zero vectors."""
    usable = rows.where(F.size(vector) > 0).select(F.col(vector).cast("array<double>").alias("v")).where(F.exists("v", lambda x: x != 0))
    taken = usable.orderBy(F.xxhash64("v")).limit(sample).toPandas()["v"]
    out = {}
    for width in sorted({len(v) for v in taken}):
        points = unit_rows(np.array([v for v in taken if len(v) == width]))
        middles = points[: max(1, min(cells, len(points) // 8))].copy()
        for _ in range(sweeps):
            near = np.argmax(points @ middles.T, axis=1)
            sums = np.zeros_like(middles)
            np.add.at(sums, near, points)
            size = np.linalg.norm(sums, axis=1)
            middles[size > 0] = sums[size > 0] / size[size > 0, None]
        out[width] = middles
    return out


def _placed(rows: DataFrame, model: dict[int, np.ndarray]) -> DataFrame:
    """(id, v) with width, the nearest centroid's number (-1 for zero vectors and widths the sample lacked) and the angle to it."""
    schema = f"id {rows.schema['id'].dataType.simpleString()}, v array<float>, width int, cell int, angle double"

    def run(batches):
        for batch in (whole.slice(i, _ROWS) for whole in batches for i in range(0, len(whole), _ROWS)):
            v = batch.column(1)
            size = np.diff(v.offsets.to_numpy())
            flat, starts = v.values.to_numpy(zero_copy_only=False), v.offsets.to_numpy()
            cell, angle = np.full(len(size), -1, np.int32), np.zeros(len(size))
            for width, middles in model.items():
                at = np.flatnonzero(size == width)
                points = unit_rows(flat[starts[at, None] + np.arange(width)].astype(np.float64))
                sims = points @ middles.T
                best = np.argmax(sims, axis=1) if len(at) else np.zeros(0, np.int64)
                some = np.abs(points).sum(axis=1) > 0
                cell[at[some]] = best[some]
                angle[at[some]] = np.arccos(np.clip(sims[np.arange(len(at)), best], -1, 1))[some]
            yield pa.RecordBatch.from_arrays([batch.column(0), v, pa.array(size.astype(np.int32)), pa.array(cell), pa.array(angle)], names=["id", "v", "width", "cell", "angle"])

    bounded_batches(rows.sparkSession)
    return rows.mapInArrow(run, schema)


def _usable(rows: DataFrame, key: str, vector: str) -> DataFrame:
    return rows.where(F.size(vector) > 0).select(F.col(key).alias("id"), F.transform(vector, lambda x: F.coalesce(x, F.lit(0.0)).cast("float")).alias("v"))


def build_cells(rows: DataFrame, key: str, path: str, vector: str = "embedding", cells: int = 1024, sample: int = 50_000, chunk_bytes: int = 1 << 20) -> None:
    """Under path: centroids (width, cell, c), chunks (width, cell, chunk, lo, hi, ids, flat) and reach (width, cell, lo, hi, n), a row a cell."""
    spark = rows.sparkSession
    model = centroids(rows, key, vector, cells, sample)
    kept = [(w, i, [float(x) for x in c]) for w, m in model.items() for i, c in enumerate(m)]
    spark.createDataFrame(kept, "width int, cell int, c array<double>").write.parquet(f"{path}/centroids")
    shift = max(0, int(np.log2(max(1, chunk_bytes / 4 / max(model, default=1)))))
    order = ["width", "cell", "angle", "id"]
    dealt = _placed(_usable(rows, key, vector), model).repartitionByRange(*order).sortWithinPartitions(*order)
    dealt.withColumn("chunk", F.shiftright(F.monotonically_increasing_id(), shift)).write.parquet(f"{path}/dealt")
    rows_of = F.collect_list(F.struct("id", "v")).alias("rows")  # at most 2 ** shift
    angles = (F.min("angle").alias("lo"), F.when(F.col("cell") < 0, F.lit(float(np.pi))).otherwise(F.max("angle")).alias("hi"))
    chunks = spark.read.parquet(f"{path}/dealt").groupBy("width", "cell", "chunk").agg(*angles, rows_of)
    chunks.select("width", "cell", "chunk", "lo", "hi", F.col("rows.id").alias("ids"), F.flatten("rows.v").alias("flat")).repartitionByRange("width", "cell", "lo").sortWithinPartitions("width", "cell", "lo").write.parquet(f"{path}/chunks")
    spark.read.parquet(f"{path}/chunks").groupBy("width", "cell").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum(F.size("ids")).alias("n")).coalesce(1).write.parquet(f"{path}/reach")


def _met(pairs: DataFrame, k: int) -> DataFrame:
    """(qid, id, sim): of each block and chunk, the best k + 1 rows for each query, ties included."""
    kinds = pairs.schema["qids"].dataType.elementType.simpleString(), pairs.schema["ids"].dataType.elementType.simpleString()

    def run(batches):
        for batch in batches:
            qids, qflat, ids, flat = (batch.column(batch.schema.get_field_index(n)) for n in ("qids", "qflat", "ids", "flat"))
            for i, width in enumerate(batch.column(batch.schema.get_field_index("width")).to_pylist()):
                q, x = (unit_rows(c[i].values.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)) for c in (qflat, flat))
                sims = np.round(x @ q.T, 12)  # so that equal ones tie
                n = min(k + 1, len(x))
                at, of = np.nonzero(sims >= np.partition(sims, len(x) - n, axis=0)[len(x) - n])
                yield pa.RecordBatch.from_arrays([qids[i].values.take(pa.array(of)), ids[i].values.take(pa.array(at)), pa.array(sims[at, of])], names=["qid", "id", "sim"])

    bounded_batches(pairs.sparkSession)  # a pair is a megabyte and more, so 10,000 of them are no batch
    return pairs.select("width", "qids", "qflat", "ids", "flat").mapInArrow(run, f"qid {kinds[0]}, id {kinds[1]}, sim double")


def _reached(blocks: DataFrame, model: dict[int, np.ndarray], reach: dict[int, list]) -> DataFrame:
    """(block, width, cell, low, high): the angles each block needs of each cell but its own, from blocks (block, width, home, qflat, rs)."""

    def run(batches):
        for batch in batches:
            out = []
            names = ("block", "width", "home", "qflat", "rs")
            for block, width, home, qflat, rs in zip(*(batch.column(batch.schema.get_field_index(n)) for n in names), strict=True):
                w, r = width.as_py(), np.array(rs.as_py())
                q = unit_rows(qflat.values.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, w))
                for cell, lo, hi in reach.get(w, ()):
                    if cell == home.as_py():
                        continue
                    if cell < 0:
                        out.append((block.as_py(), w, cell, 0.0, float(np.pi)))
                        continue
                    theta = np.arccos(np.clip(q @ model[w][cell], -1, 1))
                    low, high = theta - r, np.where(r >= np.pi, np.pi, theta + r)
                    need = (hi >= low) & (lo <= high)
                    if need.any():
                        out.append((block.as_py(), w, cell, float(low[need].min()), float(high[need].max())))
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array([o[j] for o in out], kind) for j, kind in enumerate(kinds)], names=["block", "width", "cell", "low", "high"])

    return blocks.select("block", "width", "home", "qflat", "rs").mapInArrow(run, "block long, width int, cell int, low double, high double")


def nearest_in_cells(spark: SparkSession, path: str, queries: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """((qid, id, sim, place), reads): the best k rows for each query (qid, qvec), a row of the query's own key left out, as vectorsearch.nearest_by_row;
    and one row (met, every): how many pairs of query and row were compared, of how many there are of equal width."""
    chunks = spark.read.parquet(f"{path}/chunks")
    cell_rows = spark.read.parquet(f"{path}/reach").collect()  # a row a cell: as many as the `cells` the index was built with
    model = {}
    for r in sorted(spark.read.parquet(f"{path}/centroids").collect(), key=lambda r: (r["width"], r["cell"])):
        model.setdefault(r["width"], []).append(r["c"])
    model = {w: np.array(m) for w, m in model.items()}
    reach: dict[int, list] = {}
    for r in cell_rows:
        reach.setdefault(r["width"], []).append((r["cell"], r["lo"], r["hi"]))

    at = f"{ensure_checkpoint_dir(spark)}/knn-{queries._jdf.hashCode() & 0xFFFFFFFF:x}-{np.random.default_rng().integers(1 << 60):x}"
    order = ["width", "cell", "id"]
    placed = _placed(_usable(queries, "qid", "qvec"), model).repartitionByRange(*order).sortWithinPartitions(*order)
    placed.withColumn("block", F.shiftright(F.monotonically_increasing_id(), _BLOCK_SHIFT)).write.parquet(f"{at}/queries")
    grouped = spark.read.parquet(f"{at}/queries").groupBy("width", "cell", "block").agg(F.sort_array(F.collect_list(F.struct("id", "v"))).alias("rows"))
    grouped = grouped.select(F.xxhash64("width", "cell", "block").alias("block"), "width", F.col("cell").alias("home"), F.col("rows.id").alias("qids"), F.flatten("rows.v").alias("qflat"))
    grouped.write.parquet(f"{at}/blocks")
    blocks = spark.read.parquet(f"{at}/blocks")
    own = chunks.withColumnRenamed("cell", "home")
    _met(blocks.join(own, ["width", "home"]), k).where("NOT qid <=> id").write.parquet(f"{at}/first")
    first = spark.read.parquet(f"{at}/first")

    best = Window.partitionBy("qid").orderBy(F.col("sim").desc(), "id")
    kth = first.withColumn("place", F.row_number().over(best)).where(F.col("place") == k).select("qid", F.col("sim").alias("kth"))
    everything = (F.col("home") < 0) | F.col("kth").isNull()  # a query at no angle to anything, or with fewer than k rows in its cell
    angle = F.when(everything, F.lit(float(np.pi))).otherwise(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("kth")))) + _SLACK)
    with_r = blocks.select("block", "home", F.posexplode("qids").alias("pos", "qid")).join(kth, "qid", "left").groupBy("block").agg(F.sort_array(F.collect_list(F.struct("pos", angle.alias("r")))).alias("rs"))
    _reached(blocks.join(with_r.select("block", F.col("rs.r").alias("rs")), "block"), model, reach).write.parquet(f"{at}/pairs")
    pairs = spark.read.parquet(f"{at}/pairs")
    needed = pairs.join(blocks.select("block", "qids", "qflat"), "block").join(chunks, ["width", "cell"]).where("hi >= low AND lo <= high")
    found = first.unionByName(_met(needed, k).where("NOT qid <=> id"))

    size = F.sum((F.size("qids") * F.size("ids")).cast("long"))
    met = needed.select("qids", "ids").unionByName(blocks.join(own, ["width", "home"]).select("qids", "ids")).agg(F.coalesce(size, F.lit(0)).alias("met"))
    asked = blocks.groupBy("width").agg(F.sum(F.size("qids")).alias("q")).join(spark.read.parquet(f"{path}/reach").groupBy("width").agg(F.sum("n").alias("n")), "width")
    reads = met.crossJoin(asked.agg(F.coalesce(F.sum(F.col("q") * F.col("n")), F.lit(0)).alias("every")))  # one row each
    ranked = found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k)
    return ranked, reads
