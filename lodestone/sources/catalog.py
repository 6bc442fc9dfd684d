"""Reading and writing catalogues, vector artifacts and JSON archives with Spark's own sources."""

from __future__ import annotations

import tempfile

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.sources import store

SYMBOL_SCHEMA = "id string, framework string, title string, kind string, abstract string, path string, platforms array<string>, is_primary boolean"
VECTOR_SCHEMA = "id string, framework string, title string, kind string, summary string, path string, media_url string, media_type string, embedding array<float>"


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the session.  Where none is set, a temporary one in local mode (tests), and an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="lodestone-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def bounded_batches(spark: SparkSession, most: str = "8m") -> None:
    """Keeps an Arrow batch small where the session leaves Spark's default, for rows of long texts, token lists or blocks of vectors."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) in ("67108864b", "64m", "64MB"):
        spark.conf.set(name, most)


def parse_platforms(raw: Column) -> Column:
    """A JSON array of names; anything else is an empty array."""
    return F.coalesce(F.when(F.trim(raw).startswith("["), F.from_json(raw, "array<string>")), F.array().cast("array<string>"))


def open_catalog(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Tables of a store written by save_catalog, with fixed schemas, so no file is read to infer one."""
    return {"symbols": spark.read.schema(SYMBOL_SCHEMA).parquet(f"{path}/symbols"), "vectors": spark.read.schema(VECTOR_SCHEMA).parquet(f"{path}/vectors")}


def save_symbols(symbols: DataFrame, path: str) -> None:
    """Symbols clustered by framework, the column most filters name; the write is atomic by Spark's commit protocol."""
    symbols.repartitionByRange("framework").sortWithinPartitions("framework", "path").write.mode("overwrite").parquet(f"{path}/symbols")


def save_catalog(symbols: DataFrame, vectors: DataFrame, path: str) -> None:
    save_symbols(symbols, path)
    vectors.write.mode("overwrite").parquet(f"{path}/vectors")


def read_archives(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """JSON pages below *.doccarchive folders, one a file, with the archive's name; a file that is no JSON has `corrupt` set."""
    pages = spark.read.schema(f"{schema}, corrupt string").option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").option("columnNameOfCorruptRecord", "corrupt").json(root)
    at = F.col("_metadata.file_path")
    return pages.withColumn("archive", F.regexp_extract(at, r"([^/]+)\.doccarchive/", 1)).withColumn("file", at).where("archive <> '' AND file LIKE '%/data/documentation/%'")


def archive_counts(pages: DataFrame) -> DataFrame:
    return pages.groupBy("archive").agg(F.count("*").alias("pages"), F.count_if(F.col("corrupt").isNotNull()).alias("corrupt"))


def export_rows(vectors: DataFrame, dims: int, where: Column | None = None) -> DataFrame:
    kept = vectors.where(F.size("embedding") == dims)
    return kept if where is None else kept.where(where)


def export_vectors(vectors: DataFrame, dims: int, path: str, model: str, exported_at: str, where: Column | None = None) -> DataFrame:
    """Writes the vectors of one width and a one-row manifest beside them; returns the manifest."""
    kept = export_rows(vectors, dims, where)
    kept.write.mode("overwrite").parquet(f"{path}/vectors")
    written = vectors.sparkSession.read.parquet(f"{path}/vectors")
    digest = F.sha2(F.array_join(F.sort_array(F.collect_list(F.sha2("content", 256))), ""), 256)  # one short hash a file
    files = vectors.sparkSession.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(f"{path}/vectors").agg(digest.alias("sha256"), F.sum("length").alias("byteSize"))
    facts = written.agg(F.count("*").alias("totalVectors"))
    manifest = facts.crossJoin(files).select(F.lit(1).alias("formatVersion"), "sha256", "byteSize", "totalVectors", F.lit(dims).alias("dimensions"), F.lit(model).alias("embeddingModel"), F.lit(exported_at).alias("exportedAt"))  # one row each
    manifest.coalesce(1).write.mode("overwrite").json(f"{path}/manifest")
    return vectors.sparkSession.read.json(f"{path}/manifest")


def import_vectors(spark: SparkSession, path: str, own: DataFrame, key: str, compatible: bool = True) -> DataFrame:
    """Imported rows replace own rows of the same key; with an incompatible model nothing of the own rows stays.  The checksum is verified first."""
    manifest = spark.read.json(f"{path}/manifest").first()
    digest = F.sha2(F.array_join(F.sort_array(F.collect_list(F.sha2("content", 256))), ""), 256)
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(f"{path}/vectors").agg(digest.alias("sha256")).first()
    if found["sha256"] != manifest["sha256"]:
        raise ValueError(f"the vectors under {path} do not match their manifest")
    new = spark.read.parquet(f"{path}/vectors")
    return new if not compatible else own.join(new.select(key), key, "left_anti").unionByName(new)


def compact(spark: SparkSession, path: str, to: str, files: int) -> None:
    spark.read.parquet(path).coalesce(files).write.mode("overwrite").parquet(to)


def ingest_archives(spark: SparkSession, root: str, to: str, now: str, only: str | None = None, dry_run: bool = False) -> DataFrame:
    """Pages below root become symbols under `to`, upserted into those there, with a new index and meta; returns (archive, pages, corrupt).  A dry run writes nothing."""
    from lodestone.operators import fulltext, ingest

    ensure_checkpoint_dir(spark)
    pages = read_archives(spark, root, ingest.PAGE_SCHEMA).checkpoint()  # parsed once for the report and the rows
    if only:
        pages = pages.where(F.lower("archive") == only.lower())
    report = archive_counts(pages)
    if dry_run:
        return report
    found = ingest.page_rows(pages.where("corrupt IS NULL"), F.col("archive")).withColumn("at", F.lit(1))
    try:
        old = spark.read.schema(SYMBOL_SCHEMA).parquet(f"{to}/symbols")
        found = old.withColumn("at", F.lit(0)).unionByName(found.select(*old.columns, "at"))
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    merged = ingest.upsert(found.select("id", "framework", "title", "kind", "abstract", "path", "platforms", "is_primary", "at"), "id", ["at", "title", "abstract"]).drop("at").checkpoint()
    save_symbols(merged, to)
    if not store.exists(spark, f"{to}/vectors"):  # vectors that are there stay
        spark.createDataFrame([], VECTOR_SCHEMA).write.parquet(f"{to}/vectors")
    symbols = spark.read.parquet(f"{to}/symbols")
    fulltext.build_index(symbols, "id", ["title", "framework", "kind", "abstract"], f"{to}/index")
    facts = symbols.agg(F.count("*").cast("string").alias("symbol_count"), F.array_join(F.sort_array(F.collect_set("framework")), ",").alias("frameworks"))  # framework names are few
    pairs = F.array(*(F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in (("built_at", F.lit(now)), ("symbol_count", F.col("symbol_count")), ("frameworks", F.col("frameworks")))))
    facts.select(F.explode(pairs).alias("m")).select("m.*").coalesce(1).write.mode("overwrite").parquet(f"{to}/meta")
    return report
