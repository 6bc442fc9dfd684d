"""BM25 over weighted columns, by scan or from a stored index.

score(row) = sum over phrases of idf * f * (k1 + 1) / (f + k1 * (1 - b + b * |row| / mean))
idf = ln((N - n + 0.5) / (n + 0.5)), at least 1e-6; f = sum over columns of weight * occurrences; n = rows that hold the phrase in any column.

Statistics always cover the whole table; filters apply to the scored rows only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import inverted
from lodestone.sources import store
from lodestone.sources.catalog import bounded_batches, ensure_checkpoint_dir

K1, B, FLOOR = 1.2, 0.75, 1e-6
SPREAD = 8  # files that a term may lie in


@dataclass(frozen=True)
class Phrase:
    """Adjacent tokens of one column; with `prefix`, the last may go on."""

    words: tuple[str, ...]
    prefix: bool = False

    @classmethod
    def of(cls, text: str, prefix: bool = True) -> Phrase:
        return cls(tuple(T.query_tokens(text)), prefix)

    def count(self, joined: Column) -> Column:
        """Places in ` token token ...`; the lookahead lets phrases overlap, which single words can't."""
        place = f" {' '.join(self.words)}{'' if self.prefix else '(?= |$)'}"
        return F.regexp_count(joined, F.lit(place if len(self.words) == 1 else f"(?={place})"))


def plan_query(query: str) -> list[list[Phrase]]:
    """Alternatives in order: all prefixes; for one camelCase token its prefix or its words as a phrase."""
    clean = T.sanitize_query(query)
    if " " not in clean and clean:
        words = T.camel_words(clean)
        if len(words) > 1 and all(len(w) >= 2 for w in words):
            return [[Phrase.of(clean), Phrase(tuple(t for w in words for t in T.query_tokens(w)))]]
    return [[p] for p in (Phrase.of(t) for t in clean.split()) if p.words]


def counted(rows: DataFrame, columns: Mapping[str, float], phrases: Sequence[Phrase]) -> DataFrame:
    """rows with __dl, and for each phrase __f (weighted) and __n (whether it occurs)."""
    for name in columns:
        rows = rows.withColumn(f"__t_{name}", T.tokens(F.col(name)))
    length = sum((F.size(f"__t_{name}") for name in columns), F.lit(0))
    out = rows.withColumn("__dl", length)
    for i, phrase in enumerate(phrases):
        # One string of a column's tokens: no lambda, so generated code computes the tokens once for all phrases and the length.
        each = {name: phrase.count(F.concat(F.lit(" "), F.array_join(F.col(f"__t_{name}"), " "))) for name in columns}
        out = out.withColumn(f"__c{i}", F.array(*each.values()))
        out = out.withColumn(f"__f{i}", sum((F.get(f"__c{i}", j) * F.lit(float(w)) for j, w in enumerate(columns.values())), F.lit(0.0)))
        out = out.withColumn(f"__n{i}", F.array_max(f"__c{i}") > 0).drop(f"__c{i}")
    return out.drop(*(f"__t_{name}" for name in columns))


def bm25(rows: DataFrame, columns: Mapping[str, float], phrases: Sequence[Phrase], match: str = "all", where: Column | None = None, groups: Sequence[Sequence[int]] | None = None) -> DataFrame:
    """rows that match, with `score` (higher is better).  match: 'all' or 'any' of the phrases; or `groups` of phrase numbers, one of each group."""
    measured = counted(rows, columns, phrases)
    totals = measured.agg(F.count("*").alias("__N"), F.avg("__dl").alias("__mean"), *(F.count_if(f"__n{i}").alias(f"__df{i}") for i in range(len(phrases))))
    hits = [F.col(f"__n{i}") for i in range(len(phrases))]
    if groups is None:
        groups = [[i] for i in range(len(phrases))] if match == "all" else [list(range(len(phrases)))]
    wanted = F.lit(True)
    for group in groups:
        one = F.lit(False)
        for i in group:
            one = one | hits[i]
        wanted = wanted & one
    scored = measured.where(wanted if where is None else wanted & where).crossJoin(F.broadcast(totals))  # totals is one row
    score = F.lit(0.0)
    for i in range(len(phrases)):
        idf = F.greatest(F.ln((F.col("__N") - F.col(f"__df{i}") + 0.5) / (F.col(f"__df{i}") + 0.5)), F.lit(FLOOR))
        idf = F.when(F.col("__N") - F.col(f"__df{i}") > F.col(f"__df{i}"), idf).otherwise(FLOOR)
        f = F.col(f"__f{i}")
        score = score + idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("__dl") / F.col("__mean")))
    return scored.withColumn("score", score).select(*rows.columns, "score")


def search(rows: DataFrame, columns: Mapping[str, float], query: str, where: Column | None = None) -> DataFrame:
    """All tokens of the query as prefixes; only if no row has them all, any of them at half the score."""
    groups = plan_query(query)
    phrases = [p for group in groups for p in group]
    if not phrases:
        return rows.limit(0).withColumn("score", F.lit(0.0))
    numbers, at = [], 0
    for group in groups:
        numbers.append(list(range(at, at + len(group))))
        at += len(group)
    every = bm25(rows, columns, phrases, where=where, groups=numbers)
    if len(groups) == 1 or not every.isEmpty():
        return every
    return bm25(rows, columns, phrases, match="any", where=where).withColumn("score", F.col("score") * 0.5)


def search_any(rows: DataFrame, columns: Mapping[str, float], query: str, title: str, primary: str, where: Column | None = None) -> DataFrame:
    """Any of the first six prefixes of two letters or more; `tier` is the title's closeness to the query, and `rank` (lower first) favours primary rows."""
    words = [t for t in T.query_tokens(T.sanitize_query(query)) if len(t) >= 2][:6]
    return tiered(bm25(rows, columns, [Phrase((w,), True) for w in words], match="any", where=where), query, title, primary)


def tiered(found: DataFrame, query: str, title: str, primary: str) -> DataFrame:
    name, q = F.lower(title), query.lower()
    tier = F.when(name == q, 0).when(name.startswith(q + "("), 1).when(name.startswith("func " + q + "("), 2).otherwise(3)
    return found.withColumn("tier", tier).withColumn("rank", -F.col("score") - 4.0 * F.col(primary).cast("int"))


def with_exact_titles(found: DataFrame, rows: DataFrame, title: str, primary: str, key: str, query: str, most: int = 5, score: float = 1000.0) -> DataFrame:
    """Rows whose title is the query come first at a fixed score; the others follow without them."""
    exact = rows.where(F.lower(title) == query.lower()).orderBy(F.col(primary).desc(), key).limit(most).withColumn("score", F.lit(score)).withColumn("stage", F.lit("exact"))
    rest = found.withColumn("stage", F.lit("fts")).join(exact.select(key), key, "left_anti")
    return exact.unionByName(rest.select(*exact.columns))


def boosted(found: DataFrame, title: str, query: str, mapped: Sequence[str] = ()) -> DataFrame:
    """+100 where the title is the query, +50 where it is one of the mapped names."""
    name = F.lower(title)
    extra = F.when(name == query.lower(), 100.0).otherwise(0.0)
    if mapped:
        extra = extra + F.when(name.isin(*[m.lower() for m in mapped]), 50.0).otherwise(0.0)
    return found.withColumn("score", F.col("score") + extra)


# A stored index: postings clustered by term, so that a term or prefix reads few row groups.


def build_index(rows: DataFrame, key: str, columns: Sequence[str], path: str) -> None:
    """Under path: postings (term, col, docs, counts, places), each file in order of term, those of a common term in several files; lengths (doc, dl); totals (rows_all, mean).

    Texts are read once, and batches of them turned round where they are.  What leaves a task are rows of a term and batch, not of a token; they are shuffled once and written once,
    by hash, as ranges would be sampled from a first copy.  Lengths come along without a term.
    """
    spark = rows.sparkSession
    bounded_batches(spark)
    kind = rows.schema[key].dataType.simpleString()
    lists = rows.select(F.col(key).alias("doc"), *(T.tokens(F.col(c)).alias(f"t{i}") for i, c in enumerate(columns)))
    turned = lists.mapInArrow(inverted.by_id(columns), f"term string, col string, docs array<{kind}>, counts array<int>, places array<int>")
    turned = turned.withColumn("turn", F.monotonically_increasing_id()).withColumn("what", F.when(F.col("term").isNull(), "lengths").otherwise("postings"))
    dealt = turned.repartition("term", F.col("turn") % SPREAD).sortWithinPartitions("what", "term", "col", "turn").drop("turn")
    schema = dealt.drop("what").schema
    dealt.write.mode("overwrite").partitionBy("what").option("parquet.page.row.count.limit", 256).option("parquet.page.size.row.check.min", 16).parquet(f"{path}/turned")
    if store.exists(spark, f"{path}/turned/what=postings"):
        store.move(spark, f"{path}/turned/what=postings", f"{path}/postings")
    else:
        spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{path}/postings")
    lengths = spark.read.schema(schema).parquet(f"{path}/turned").where("term IS NULL").select(F.inline(F.arrays_zip(F.col("docs").alias("doc"), F.col("counts").alias("dl"))).alias("doc", "dl"))
    lengths.write.mode("overwrite").parquet(f"{path}/lengths")
    store.delete(spark, f"{path}/turned")
    lengths = spark.read.parquet(f"{path}/lengths")
    lengths.agg(F.count("*").alias("rows_all"), F.avg("dl").alias("mean")).write.mode("overwrite").parquet(f"{path}/totals")


def index_once(rows: DataFrame, key: str, columns: Sequence[str], name: str, source: str) -> str:
    """The folder of an index that this application built before under a name from the files now at `source`, or builds now."""
    return built_once(rows.sparkSession, name, source, lambda path: build_index(rows, key, columns, path))


def built_once(spark: SparkSession, name: str, source: str, build: Callable[[str], object]) -> str:
    """The folder that build(folder) filled before in this application under a name and for the files now at `source`, or fills now: changed files mean a new folder."""
    mark = hashlib.md5(f"{name} {store.snapshot(spark, source)}".encode()).hexdigest()
    path = f"{ensure_checkpoint_dir(spark)}/index-{spark.sparkContext.applicationId}-{mark}"
    if not store.exists(spark, f"{path}/built"):
        build(path)
        store.touch(spark, f"{path}/built")
    return path


def _matches(term: Column, word: str, prefix: bool) -> Column:
    return term.startswith(word) if prefix else term == word


def occurrences(postings: DataFrame, phrases: Sequence[Phrase], weights: Mapping[str, float], by: Sequence[str] = ()) -> DataFrame:
    """(*by, doc, i, f): weighted occurrences of each phrase in each row that has it.  Single words and prefixes share one scan with their filters pushed and read no places; longer phrases join on places."""
    weight = F.element_at(F.create_map(*[F.lit(x) for pair in weights.items() for x in (pair[0], float(pair[1]))]), F.col("col"))
    postings = postings.where(F.col("col").isin(*weights))
    found = []
    single = {i: _matches(F.col("term"), p.words[0], p.prefix) for i, p in enumerate(phrases) if len(p.words) == 1}
    if single:
        wanted = F.lit(False)
        for test in single.values():
            wanted = wanted | test
        which = F.explode(F.array_compact(F.array(*(F.when(test, i) for i, test in single.items()))))
        rows = postings.where(wanted).select(*by, "docs", "counts", which.alias("i"), weight.alias("w"))
        rows = rows.select(*by, "i", "w", F.inline(F.arrays_zip("docs", "counts")).alias("doc", "n"))
        found.append(rows.select(*by, "doc", "i", (F.col("n") * F.col("w")).alias("w")))
    each = F.flatten(F.zip_with("docs", "counts", lambda doc, n: F.array_repeat(doc, n)))
    for i, p in enumerate(phrases):
        if len(p.words) > 1:
            word = lambda j, p=p: (
                postings.where(_matches(F.col("term"), p.words[j], p.prefix and j + 1 == len(p.words)))
                .select(*by, "col", F.inline(F.arrays_zip(each.alias("doc"), F.col("places").alias("pos"))).alias("doc", "pos"))
                .withColumn("pos", F.col("pos") - j)
            )
            places = word(0)
            for j in range(1, len(p.words)):
                places = places.join(word(j), [*by, "doc", "col", "pos"])
            found.append(places.select(*by, "doc", F.lit(i).alias("i"), weight.alias("w")))
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    return every.groupBy(*by, "doc", "i").agg(F.sum("w").alias("f"))


def search_index(spark: SparkSession, path: str, weights: Mapping[str, float], groups: Sequence[Sequence[Phrase]], match: str = "all") -> DataFrame:
    """(doc, score, hits) from a stored index that holds the columns of weights and no others; hits counts the groups met.  match: 'all' groups, 'any', or 'each' row that meets one."""
    postings, lengths, totals = (spark.read.parquet(f"{path}/{name}") for name in ("postings", "lengths", "totals"))
    phrases = [p for group in groups for p in group]
    if not phrases:
        return lengths.limit(0).select("doc", F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("hits"))
    tf = occurrences(postings, phrases, weights)
    df = tf.groupBy("i").agg(F.count("*").alias("n"))
    joined = tf.join(F.broadcast(df), "i").join(lengths, "doc").crossJoin(F.broadcast(totals))  # df has a row a phrase, totals one row
    return scored(joined, groups, match)


def part(n: Column, rows_all: Column, f: Column, dl: Column, mean: Column) -> Column:
    """What a phrase that stands in n of rows_all rows adds to the score of a row with weight f and length dl.  It grows with f and falls with dl."""
    others = rows_all - n
    idf = F.when(others > n, F.greatest(F.ln((others + 0.5) / (n + 0.5)), F.lit(FLOOR))).otherwise(FLOOR)
    return idf * f * (K1 + 1) / (f + K1 * (1 - B + B * dl / mean))


def group_of(groups: Sequence[Sequence[Phrase]]) -> Column:
    """The group of phrase number `i`."""
    return F.element_at(F.array(*(F.lit(g) for g, group in enumerate(groups) for _ in group)), F.col("i") + 1)


def scored(joined: DataFrame, groups: Sequence[Sequence[Phrase]], match: str) -> DataFrame:
    """(doc, score, hits) from (doc, i, f, n, dl, rows_all, mean)."""
    parts = part(F.col("n"), F.col("rows_all"), F.col("f"), F.col("dl"), F.col("mean"))
    out = joined.groupBy("doc").agg(F.sum(parts).alias("score"), F.countDistinct(group_of(groups)).alias("hits"))
    return out.where(F.col("hits") == len(groups)) if match == "all" else out


def find(rows: DataFrame, key: str, index: str, weights: Mapping[str, float], query: str, where: Column | None = None) -> DataFrame:
    """What `search` finds, from a stored index: the rows with all tokens of the query, or, if there are none, those with any at half the score, out of one pass over their postings."""
    groups = plan_query(query)
    found = search_index(rows.sparkSession, index, weights, groups, "any").withColumnRenamed("doc", key)
    kept = (rows if where is None else rows.where(where)).join(found, key).select(*rows.columns, "score", F.col("hits").alias("__hits"))
    if len(groups) < 2:
        return kept.drop("__hits")
    most = kept.agg(F.max("__hits").alias("__most"))  # one row
    whole = F.col("__most") == len(groups)
    chosen = kept.crossJoin(F.broadcast(most)).where(~whole | (F.col("__hits") == len(groups)))
    return chosen.withColumn("score", F.when(whole, F.col("score")).otherwise(F.col("score") * 0.5)).drop("__hits", "__most")


def find_any(rows: DataFrame, key: str, index: str, weights: Mapping[str, float], query: str, title: str, primary: str, where: Column | None = None) -> DataFrame:
    """What `search_any` finds, from a stored index."""
    words = [t for t in T.query_tokens(T.sanitize_query(query)) if len(t) >= 2][:6]
    found = search_index(rows.sparkSession, index, weights, [[Phrase((w,), True)] for w in words], "any").withColumnRenamed("doc", key)
    return tiered((rows if where is None else rows.where(where)).join(found.drop("hits"), key).select(*rows.columns, "score"), query, title, primary)


def index_drift(rows: DataFrame, spark, path: str) -> DataFrame:
    """One row: documents in the index, rows in the table, whether they differ."""
    indexed = spark.read.parquet(f"{path}/lengths").agg(F.countDistinct("doc").alias("indexed"))
    return indexed.crossJoin(rows.agg(F.count("*").alias("base"))).withColumn("drift", F.col("indexed") != F.col("base"))  # both are one row
