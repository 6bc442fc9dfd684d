"""Mixing sources to target weights by Pareto order sampling, in DataFrame operations only.

1. Targets.  Sources share `share` of all words by weight; a target stops at `most` times its source's size, and the excess is
   shared again by weight (water filling, solved in closed form over the sources sorted by the ratio at which they fill up).
2. Expected copies.  Inside a source a document expects min(most, rate * measure) copies.  The measure grows mildly with the
   document's size class (bit length of its word count), and the rate makes the expected words meet the target.
3. Whole copies are certain.  The fraction left is the inclusion probability p of one further copy.
4. Pareto order.  A document's rank is its random odds u / (1 - u) over its inclusion odds p / (1 - p).  A source takes the
   lowest ranks until its words reach what the certain copies left open: a sample whose size is fixed, of unequal probabilities.

u comes from md5 of seed, id and size, so reruns agree.  No source is ever gathered in one task: running totals are taken over
at most `buckets` rank buckets a source, and only the one bucket in which a source ends is ordered row by row.

Defined cases: a null text has size 0, and such rows take 0; a null source is a source of its own, last in the order of
sources; rows that agree in rank are ordered by id, size and md5 of the text; repeated rows are documents of their own; an empty
table gives no rows; only doc_id, text and source are read, so further columns do not matter.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm.common import WORD, shared_dir, table

WEIGHTS = (3, 1, 2)


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = 1.5, most: int = 2) -> DataFrame:
    """(source, source_size, target) from (source, source_size): one row a source, so one task sees sources only."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    fill = Window.orderBy("fills_at", F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(by_name) - 1) % len(weights) + 1)
    ranked = sizes.withColumn("weight", weight).withColumn("fills_at", F.lit(float(most)) * F.col("source_size") / F.col("weight"))
    total, everything = Window.partitionBy(), F.col("source_size")
    ranked = (
        ranked.withColumn("filled", F.sum(everything).over(fill.rowsBetween(Window.unboundedPreceding, -1)))
        .withColumn("open_weight", F.sum("weight").over(fill.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", (F.lit(share) * F.sum(everything).over(total) - most * F.coalesce("filled", F.lit(0))) / F.col("open_weight"))
    )
    level = F.min(F.when(F.col("level") <= F.col("fills_at"), F.struct("fills_at", "level"))).over(total)["level"]
    target = F.least(F.lit(float(most)) * everything, F.coalesce(level * F.col("weight"), F.lit(float(most)) * everything))
    return ranked.select("source", "source_size", target.alias("target"))


def same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def mix_sources(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = 1.5, most: int = 2, seed: str = "mix-1", buckets: int = 4096) -> DataFrame:
    """Returns (doc_id, source, size, source_size, target, copies, taken), a row for each row of docs."""
    shared_dir(docs.sparkSession)
    text = F.coalesce("text", F.lit(""))
    slim = docs.select("doc_id", "source", F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), F.md5(text).alias("print"))
    code = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("size").cast("string")))
    slim = slim.withColumn("u", (F.conv(F.substring(code, 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << 52)))
    slim = slim.withColumn("measure", 16 + F.when(F.col("size") > 0, F.length(F.bin("size"))).otherwise(0)).checkpoint()

    classes = slim.groupBy("source", "measure").agg(F.sum("size").alias("words"), F.count("*").alias("docs"))
    targets = source_targets(classes.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, most)
    of_source = Window.partitionBy("source")
    # The largest measures reach the cap first: with the classes above the k-th capped, the rate follows from the rest.
    above = of_source.orderBy(F.col("measure").desc()).rowsBetween(Window.unboundedPreceding, -1)
    from_here = of_source.orderBy(F.col("measure").desc()).rowsBetween(0, Window.unboundedFollowing)
    rates = (
        classes.alias("c")
        .join(targets.alias("t"), same(F.col("c.source"), F.col("t.source")))
        .select("c.source", "measure", "words", "source_size", "target")
        .withColumn("open", F.sum(F.col("measure") * F.col("words")).over(from_here))
        .withColumn("rate", (F.col("target") - most * F.coalesce(F.sum("words").over(above), F.lit(0))) / F.when(F.col("open") > 0, F.col("open")))
    )
    rate = F.max(F.when(F.col("rate") * F.col("measure") <= most, F.struct("measure", "rate"))).over(of_source)["rate"]
    rates = rates.withColumn("expected", F.when(F.col("words") == 0, F.lit(0.0)).otherwise(F.least(F.lit(float(most)), F.coalesce(rate * F.col("measure"), F.lit(float(most))))))
    rates = rates.withColumn("whole", F.floor("expected")).withColumn("p", F.col("expected") - F.col("whole"))
    rates = rates.withColumn("left", F.col("target") - F.sum(F.col("whole") * F.col("words")).over(of_source))
    rates = rates.select(F.col("source").alias("s"), F.col("measure").alias("m"), "source_size", "target", "whole", "p", "left").checkpoint()

    odds = F.col("u") / (1 - F.col("u")) / (F.col("p") / (1 - F.col("p")))
    ranked = slim.join(rates, same(F.col("source"), F.col("s")) & (F.col("measure") == F.col("m"))).drop("s", "m", "measure")
    ranked = ranked.withColumn("rank", F.when(F.col("p") > 0, odds / (1 + odds))).withColumn("bucket", F.when(F.col("rank").isNotNull(), F.least(F.floor(F.col("rank") * buckets), F.lit(buckets - 1))))
    sums = ranked.where("p > 0").groupBy("source", "bucket").agg(F.sum("size").alias("words"), F.min("left").alias("left"))
    sums = sums.withColumn("total", F.sum("words").over(of_source.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)))
    ends = sums.where("total >= left").groupBy(F.col("source").alias("s")).agg(F.min(F.struct("bucket", (F.col("left") - F.col("total") + F.col("words")).alias("open"))).alias("end"))
    ends = ends.select("s", F.col("end.bucket").alias("end"), F.col("end.open").alias("open"))

    placed = ranked.join(ends, same(F.col("source"), F.col("s")), "left").drop("s")
    last = placed.where("bucket = end")
    order = of_source.orderBy("rank", "doc_id", "size", "print").rowsBetween(Window.unboundedPreceding, 0)
    last = last.withColumn("extra", F.when(F.sum("size").over(order) - F.col("size") / 2 <= F.col("open"), 1).otherwise(0))
    rest = placed.where("bucket IS NULL OR end IS NULL OR bucket <> end")
    rest = rest.withColumn("extra", F.when(F.col("bucket").isNotNull() & (F.col("end").isNull() | (F.col("bucket") < F.col("end"))), 1).otherwise(0))
    copies = (F.col("whole") + F.col("extra")).cast("long")
    return rest.unionByName(last).select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies", "source")


OP7_SQL = r"""
WITH slim AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, md5(coalesce(text, '')) AS print FROM documents
), keyed AS (
  SELECT *, (CAST('0x' || substr(md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || size), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u,
    16 + CASE WHEN size > 0 THEN length(bin(size)) ELSE 0 END AS measure FROM slim
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM keyed GROUP BY source
), weighed AS (
  SELECT *, [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM sources
), fills AS (
  SELECT *, 2.0::DOUBLE * source_size / weight AS fills_at FROM weighed
), levels AS (
  SELECT *, (1.5::DOUBLE * (SELECT sum(source_size) FROM sources)::BIGINT - 2 * coalesce(sum(source_size) OVER (f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT)
    / CAST(sum(weight) OVER (f ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level
  FROM fills WINDOW f AS (ORDER BY fills_at, source NULLS LAST)
), targets AS (
  SELECT source, source_size, least(2.0::DOUBLE * source_size, coalesce((SELECT arg_min(level, fills_at) FROM levels WHERE level <= fills_at) * weight, 2.0::DOUBLE * source_size)) AS target FROM levels
), classes AS (
  SELECT source, measure, CAST(sum(size) AS BIGINT) AS words FROM keyed GROUP BY source, measure
), opened AS (
  SELECT c.source, measure, words, source_size, target,
    (target - 2 * coalesce(sum(words) OVER (m ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT)
      / CAST(nullif(sum(measure * words) OVER (m ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS DOUBLE) AS rate
  FROM classes c JOIN targets t ON c.source IS NOT DISTINCT FROM t.source WINDOW m AS (PARTITION BY c.source ORDER BY measure DESC)
), rated AS (
  SELECT source, arg_max(rate, measure) FILTER (rate * measure <= 2) AS rate FROM opened GROUP BY source
), expected AS (
  SELECT o.source, measure, words, source_size, target, CASE WHEN words = 0 THEN 0.0::DOUBLE ELSE least(2.0::DOUBLE, coalesce(r.rate * measure, 2.0::DOUBLE)) END AS e
  FROM opened o JOIN rated r ON o.source IS NOT DISTINCT FROM r.source
), certain AS (
  SELECT *, CAST(floor(e) AS BIGINT) AS whole, e - floor(e) AS p, target - CAST(sum(floor(e) * words) OVER (PARTITION BY source) AS DOUBLE) AS still FROM expected
), ranked AS (
  SELECT k.doc_id, k.source, k.size, k.print, source_size, target, whole, p, still,
    CASE WHEN p > 0 THEN (u / (1 - u) / (p / (1 - p))) / (1 + u / (1 - u) / (p / (1 - p))) END AS rank
  FROM keyed k JOIN certain c ON k.source IS NOT DISTINCT FROM c.source AND k.measure = c.measure
), running AS (
  SELECT *, sum(CASE WHEN rank IS NULL THEN 0 ELSE size END) OVER (PARTITION BY source ORDER BY rank NULLS LAST, doc_id, size, print ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS total FROM ranked
)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(whole + CASE WHEN rank IS NOT NULL AND total - size / 2 <= still THEN 1 ELSE 0 END AS BIGINT) AS copies,
  CAST((whole + CASE WHEN rank IS NOT NULL AND total - size / 2 <= still THEN 1 ELSE 0 END) * size AS BIGINT) AS taken, source
FROM running
"""
