"""Line dedup: cross-site boilerplate by the distinct-site spread of a line.

Every line with a word is keyed by a 64-bit hash.  A line is wide when it stands on at least `min_sites` distinct sites, one of fewer than `min_words` words on `short_factor` times as many.
Copied texts spread over sites too, and their lines belong to near dedup: a text whose wide lines hold more than `most_wide` of its words is taken for a copy and has no vote.  A line is
boilerplate when it is as wide among the texts that vote; it is removed wherever it stands.  So blocks of lines go whole, and copies neither lose their own lines nor outvote other texts.

Spreads are HyperLogLog sketches that merge by aggregation; a line whose estimate lies near its threshold (three standard errors, at least one site) is counted exactly.  Only lines seen on
two sites and often enough to pass get a sketch at all.

Documents are shuffled once, to meet the set of their own boilerplate hashes; keys and sketches are all that aggregation moves.  A line that stands everywhere is dealt out by the hash of the text
before it is sketched, and what is joined with lines is a stored table, so that its rows can be split.

Defined cases: a null text has no lines and stays null; a null source is one site; lines are split at \\n only and compared byte by byte; lines without a word always stay; a document whose lines
all go keeps an empty text; repeated rows are cleaned alike; ids are not read; an empty table gives no rows; all columns are kept, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import WORD, discard, shared_dir, stored, table


def occurrences(docs: DataFrame) -> DataFrame:
    """(print, site, at, line, words, share): one row for each line with a word; share is its part of the text's words."""
    text = docs.where("text IS NOT NULL").select(F.xxhash64("text").alias("print"), F.coalesce("source", F.lit("\x00")).alias("site"), F.split("text", "\n").alias("lines"))
    hashed = text.select("print", "site", F.transform("lines", lambda x: F.struct(F.xxhash64(x).alias("h"), F.regexp_count(x, F.lit(WORD)).alias("n"))).alias("lines"))
    total = F.aggregate("lines", F.lit(0).cast("long"), lambda sum_, x: sum_ + x["n"])
    each = hashed.select("print", "site", total.alias("total"), F.posexplode("lines").alias("at", "l")).where("l.n > 0")
    return each.select("print", "site", "at", F.col("l.h").alias("line"), F.col("l.n").alias("words"), (F.col("l.n") / F.col("total")).alias("share"))


def needed(min_sites: int, min_words: int, short_factor: int) -> Column:
    return F.when(F.col("words") >= min_words, min_sites).otherwise(short_factor * min_sites)


def wide_lines(found: DataFrame, min_sites: int = 10, min_words: int = 3, short_factor: int = 2, lg_k: int = 12, salts: int = 64) -> DataFrame:
    """(line, sites) of the lines of found (print, site, line, words) that stand on enough sites."""
    error = 3 * 1.04 / 2 ** (lg_k / 2)
    often = found.groupBy("line").agg(F.count("*").alias("n"), F.min("site").alias("a"), F.max("site").alias("b"), F.min("words").alias("words"))
    often = often.withColumn("needs", needed(min_sites, min_words, short_factor)).where((F.col("n") >= F.col("needs")) & (F.col("a") != F.col("b")))
    often = stored(often.select("line", "needs"), "often")
    rows = found.join(often.select("line"), "line", "left_semi").select("line", "site", F.pmod("print", F.lit(salts)).alias("salt"))
    pieces = rows.groupBy("line", "salt").agg(F.hll_sketch_agg("site", lg_k).alias("sites"))
    sketched = pieces.groupBy("line").agg(F.hll_sketch_estimate(F.hll_union_agg("sites")).alias("sites")).join(often, "line")
    could = F.col("sites") >= F.col("needs") * (1 - error) - 1
    near = F.abs(F.col("sites") - F.col("needs")) <= F.greatest(F.lit(1.0), error * F.col("needs"))
    sketched = stored(sketched.where(could).withColumn("near", near), "line-spread")
    exact = found.join(sketched.where("near").select("line"), "line", "left_semi").select("line", "site").distinct().groupBy("line").agg(F.count("*").alias("s"))
    spread = sketched.join(exact, "line", "left").select("line", "needs", F.coalesce("s", "sites").alias("sites"))
    wide = stored(spread.where(F.col("sites") >= F.col("needs")).select("line", "sites"), "wide-lines")
    discard(often, sketched)
    return wide


def boilerplate(found: DataFrame, min_sites: int = 10, min_words: int = 3, short_factor: int = 2, most_wide: float = 0.5) -> DataFrame:
    """(line, sites) of the boilerplate lines among occurrences."""
    wide = wide_lines(found, min_sites, min_words, short_factor)
    carried = stored(found.join(wide.select("line"), "line", "left_semi"), "wide-occurrences")
    each = carried.groupBy("print", "at").agg(F.max("share").alias("share"))
    copies = stored(each.groupBy("print").agg(F.sum("share").alias("share")).where(F.col("share") > most_wide + 1e-9).select("print"), "copied-texts")
    lines = wide_lines(carried.join(copies, "print", "left_anti"), min_sites, min_words, short_factor)
    discard(wide, carried, copies)
    return lines


def dedup_lines(docs: DataFrame, min_sites: int = 10, min_words: int = 3, short_factor: int = 2, most_wide: float = 0.5) -> DataFrame:
    """(row, text, n_lines, n_removed): row holds the columns of docs as they came, text what is left."""
    shared_dir(docs.sparkSession)
    found = stored(occurrences(docs.select("text", "source")), "line-occurrences")
    lines = boilerplate(found, min_sites, min_words, short_factor, most_wide)
    bad = stored(found.join(lines.select("line"), "line", "left_semi").groupBy("print").agg(F.collect_set("line").alias("bad")), "lines-to-go")  # a text's own lines
    discard(found, lines)
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.xxhash64("text").alias("print"))
    joined = packed.join(bad.hint("merge"), "print", "left")  # bad grows with the texts, so the plan is the same at every size
    split = F.split("row.text", "\n")
    kept = F.when(F.col("bad").isNull(), split).otherwise(F.filter(split, lambda x: ~F.array_contains("bad", F.xxhash64(x))))
    n_lines = F.coalesce(F.size(split), F.lit(0)).cast("long")
    return joined.select("row", F.array_join(kept, "\n").alias("text"), n_lines.alias("n_lines"), (n_lines - F.coalesce(F.size(kept), F.lit(0))).alias("n_removed"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    kept = F.coalesce("text", F.lit(""))
    return done.select("row.doc_id", "n_lines", "n_removed", F.length(kept).cast("long").alias("kept_chars"), F.sha2(kept, 256).alias("kept_sha256"))


OP2_SQL = r"""
WITH split AS (
  SELECT doc_id, text, coalesce(source, chr(1)) AS site, string_split(text, chr(10)) AS l FROM documents
), line AS (
  SELECT doc_id, text, site, i, l[i] AS line, len(regexp_extract_all(l[i], '[^\x20\x09-\x0D]+')) AS words
  FROM (SELECT doc_id, text, site, l, unnest(range(1, len(l) + 1)) AS i FROM split)
), wide AS (
  SELECT line FROM line WHERE words > 0 GROUP BY line HAVING count(DISTINCT site) >= CASE WHEN min(words) >= 3 THEN 10 ELSE 20 END
), copied AS (
  SELECT text FROM (SELECT DISTINCT l.text, l.i, l.words, w.line AS wide FROM line l LEFT JOIN wide w ON l.line = w.line)
  GROUP BY text HAVING sum(words) FILTER (wide IS NOT NULL) > 0.5 * sum(words)
), bad AS (
  SELECT line FROM line WHERE words > 0 AND line IN (SELECT line FROM wide) AND text NOT IN (SELECT text FROM copied)
  GROUP BY line HAVING count(DISTINCT site) >= CASE WHEN min(words) >= 3 THEN 10 ELSE 20 END
), marked AS (
  SELECT l.doc_id, l.i, l.line, b.line IS NOT NULL AS gone FROM line l LEFT JOIN bad b ON l.line = b.line
), kept AS (
  SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_removed, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '') AS t FROM marked GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, CAST(length(coalesce(t, '')) AS BIGINT) AS kept_chars, sha256(coalesce(t, '')) AS kept_sha256
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""
