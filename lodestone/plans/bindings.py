"""The test tables in the roles of a document catalogue, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import fulltext


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def document_index(spark: SparkSession, sf_dir: str) -> str:
    return fulltext.index_once(documents(spark, sf_dir), "doc_id", ["text"], "documents", f"{sf_dir}/documents.parquet")


def symbol_index(spark: SparkSession, sf_dir: str) -> str:
    return fulltext.index_once(symbols(spark, sf_dir), "id", ["title", "framework", "kind", "abstract"], "symbols", f"{sf_dir}/part.parquet")


KIND_OF_TYPE = {"ECONOMY": "struct", "PROMO": "Class", "LARGE": "func", "SMALL": "symbol", "STANDARD": "article", "MEDIUM": "property"}


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part as symbols: id, title, framework, kind, abstract, path, platforms, is_primary."""
    kind = F.lit(None).cast("string")
    for name, value in KIND_OF_TYPE.items():
        kind = F.when(F.col("p_type") == name, value).otherwise(kind)
    turn = F.col("p_size") % 4
    platforms = F.when(turn == 1, F.array(F.lit("iOS"))).when(turn == 2, F.array(F.lit("iOS"), F.lit("macOS"))).when(turn == 3, F.array(F.lit("watchOS"))).otherwise(F.array().cast("array<string>"))
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"),
        F.col("p_name").alias("title"),
        F.col("p_brand").alias("framework"),
        kind.alias("kind"),
        F.when(F.col("p_partkey") % 5 == 0, "").otherwise(F.concat("p_name", F.lit(" of size "), F.col("p_size").cast("string"))).alias("abstract"),
        F.concat(F.lit("/documentation/"), F.lower(F.regexp_replace("p_brand", "#", "")), F.lit("/"), F.regexp_replace("p_name", " ", "-")).alias("path"),
        platforms.alias("platforms"),
        F.col("p_type").isin("ECONOMY", "PROMO").alias("is_primary"),
    )


SYMBOLS = """sym AS (
  SELECT p_partkey AS id, p_name AS title, p_brand AS framework,
    CASE p_type WHEN 'ECONOMY' THEN 'struct' WHEN 'PROMO' THEN 'Class' WHEN 'LARGE' THEN 'func' WHEN 'SMALL' THEN 'symbol' WHEN 'STANDARD' THEN 'article' WHEN 'MEDIUM' THEN 'property' END AS kind,
    CASE WHEN p_partkey % 5 = 0 THEN '' ELSE p_name || ' of size ' || p_size END AS abstract,
    '/documentation/' || lower(replace(p_brand, '#', '')) || '/' || replace(p_name, ' ', '-') AS path,
    CASE p_size % 4 WHEN 1 THEN ['iOS'] WHEN 2 THEN ['iOS', 'macOS'] WHEN 3 THEN ['watchOS'] ELSE CAST([] AS VARCHAR[]) END AS platforms,
    p_type IN ('ECONOMY', 'PROMO') AS is_primary
  FROM part
)"""


def with_symbols(body: str) -> str:
    return f"WITH {SYMBOLS}{body}"


def tokens_sql(column: str) -> str:
    return rf"regexp_extract_all(lower(strip_accents(coalesce({column}, ''))), '[\p{{L}}\p{{N}}]+')"


def bm25_sql(source: str, key: str, weights: dict[str, float], phrases: list[tuple[list[str], bool]], keep: str, cols: tuple[str, ...] = (), ctes: str = "") -> str:
    """CTEs up to `scored`: key, cols and score of the rows that satisfy `keep`, an expression over n0, n1, ..."""

    def count(col: str, words: list[str], prefix: bool) -> str:
        last = "starts_with({}, '%s')" % words[-1] if prefix else "{} = '%s'" % words[-1]
        if len(words) == 1:
            return f"len(list_filter(t_{col}, lambda x: {last.format('x')}))"
        tests = " AND ".join([f"t_{col}[i + {j}] = '{w}'" for j, w in enumerate(words[:-1])] + [last.format(f"t_{col}[i + {len(words) - 1}]")])
        return f"len(list_filter(range(1, len(t_{col}) - {len(words) - 2}), lambda i: {tests}))"

    n = range(len(phrases))
    tok = ", ".join(f"{tokens_sql(c)} AS t_{c}" for c in weights)
    f = ", ".join(" + ".join(f"{w}::DOUBLE * {count(c, *phrases[i])}" for c, w in weights.items()) + f" AS f{i}" for i in n)
    flags = ", ".join(f"f{i} > 0 AS n{i}" for i in n)
    df = ", ".join(f"count(*) FILTER (f{i} > 0) AS df{i}" for i in n)
    idf = [f"(CASE WHEN N - df{i} > df{i} THEN greatest(ln((N - df{i} + 0.5::DOUBLE) / (df{i} + 0.5::DOUBLE)), 1e-6::DOUBLE) ELSE 1e-6::DOUBLE END)" for i in n]
    score = " + ".join(f"{idf[i]} * f{i} * 2.2::DOUBLE / (f{i} + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / mean))" for i in n)
    more = "".join(f", {c}" for c in cols)
    return f"""{ctes}tok AS (SELECT *, {tok} FROM {source}),
counted AS (SELECT *, {' + '.join(f'len(t_{c})' for c in weights)} AS dl, {f} FROM tok),
stats AS (SELECT count(*)::DOUBLE AS N, avg(dl) AS mean, {df} FROM counted),
flagged AS (SELECT *, {flags} FROM counted),
scored AS (SELECT {key}{more}, {score} AS score FROM flagged, stats WHERE {keep})"""
