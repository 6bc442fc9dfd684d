"""Query expansion by rules, and reciprocal rank fusion."""

from __future__ import annotations

from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.sources.catalog import bounded_batches

RRF_K = 60


def clean_text(text: Column) -> Column:
    """Lower case with everything but letters, digits and _ as single spaces."""
    return F.regexp_replace(F.lower(text), "[^a-z0-9_]+", " ")


def clean_words(text: Column) -> Column:
    """clean_text, trimmed; taking the words out of a long text is several times faster than replacing what lies between them."""
    return F.array_join(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9_]+"), F.lit(0)), " ")


def rule_terms(rules: DataFrame, slash_is_phrase: bool = False) -> DataFrame:
    """One row for each term of each rule: what to look for, and how.

    rules: rule string, terms array<string>, case_sensitive boolean, symbols array<string>, frameworks array<string>.
    """
    term = F.col("term")
    lower = F.lower(term)
    phrase = F.contains(lower, F.lit(" ")) | F.contains(lower, F.lit(":")) | (F.contains(lower, F.lit("/")) if slash_is_phrase else F.lit(False))
    exact_case = F.coalesce(F.col("case_sensitive"), F.lit(False)) & term.rlike("[A-Z]")
    literal = F.regexp_replace(F.when(exact_case, term).otherwise(lower), r"([^\p{L}\p{N}\s])", r"\\$1")
    flags = F.when(exact_case, F.lit("")).otherwise(F.lit("(?i)"))
    pattern = F.concat(flags, F.lit(r"(^|\b|\W)"), literal, F.lit(r"(\b|\W|$)"))
    rows = rules.select("*", F.explode("terms").alias("term"))
    return rows.withColumn("is_phrase", phrase).withColumn("pattern", pattern).withColumn("phrase", F.trim(clean_text(term))).withColumn("lower_term", lower)


def _hit(query: Column, low: Column, clean: Column) -> Column:
    """Whether a trimmed query, given with its lower case and its clean text, meets a term."""
    by_phrase = F.contains(low, F.col("lower_term")) | ((F.col("phrase") != "") & F.contains(clean, F.col("phrase")))
    return F.when(F.col("is_phrase"), by_phrase).otherwise(F.regexp_like(query, F.col("pattern"))) & (query != "")


def expand(queries: DataFrame, rules: DataFrame, slash_is_phrase: bool = False) -> DataFrame:
    """(qid, query, rule, symbols, frameworks) for each rule that a query meets.  The rule table is small and fixed, so it is broadcast; queries are never paired with each other."""
    q = F.trim("query")
    met = queries.join(F.broadcast(rule_terms(rules, slash_is_phrase)), _hit(q, F.lower(q), clean_text(q)))
    return met.select("qid", "query", "rule", "symbols", "frameworks", "place").distinct()


def _folded(text: str) -> str:
    """Lower case of each letter by itself, so that a letter's neighbours don't matter: only the final sigma looks at them."""
    return text.lower().replace("ς", "σ")


_CLEAN = bytes(c if chr(c) in "abcdefghijklmnopqrstuvwxyz0123456789_" else 32 for c in range(256))


def _cleaned(folded: str) -> str:
    """clean_words: every byte of another letter is a space."""
    return b" ".join(folded.encode("utf-8", "surrogatepass").translate(_CLEAN).split()).decode("ascii")


def expand_all(queries: DataFrame, rules: DataFrame, slash_is_phrase: bool = False, block: int = 50_000) -> DataFrame:
    """(qid, rule, symbols, frameworks, place) as `expand` finds them, for many rules: one Aho-Corasick automaton over the terms reads each query once; word borders and case are then checked where a term occurs.

    Rules are taken in blocks of `block` terms, so that what a task holds is bounded: a block is one pass over the queries.  A text goes through the automaton with its row and is checked in
    the same task; only ids and rule numbers are shuffled.  A phrase met in a clean text needs no second look if that is also the text that `clean_words` gives, which is compared once a text.
    """
    spark = queries.sparkSession
    bounded_batches(spark)
    out, held = [], []
    asked = queries.where(F.trim("query") != "").select("qid", F.trim("query").alias("query"))
    schema = T.StructType([asked.schema["qid"], T.StructField("query", T.StringType()), T.StructField("cleaned", T.StringType()), T.StructField("nos", T.ArrayType(T.IntegerType()))])
    terms = rule_terms(rules, slash_is_phrase).where("term IS NOT NULL").select("rule", "symbols", "frameworks", "place", "is_phrase", "pattern", "phrase", "lower_term")
    number = T.StructField("of", T.IntegerType())

    def scan(part: list) -> DataFrame:
        texts, cleans, own = {}, {}, {}
        for no, r in enumerate(part):
            own.setdefault(tuple(map(repr, r[:4])), (len(own), *r[:4]))
            if r["is_phrase"] and r["phrase"]:  # a query that holds the term holds its clean text too
                cleans.setdefault(r["phrase"], []).append(no)
            else:
                texts.setdefault(_folded(r["lower_term"]), []).append(no)

        def run(batches):
            automata = []
            for words in (texts, cleans):
                automaton = ahocorasick.Automaton()
                for word, numbers in words.items():
                    if word:
                        automaton.add_word(word, numbers)
                automaton.make_automaton()
                automata.append(automaton)
            always = texts.get("", [])

            def met(query: str) -> tuple[str, list[int]]:
                found, text = set(always), _folded(query)
                cleaned = _cleaned(text) if len(automata[1]) else ""
                for automaton, read in zip(automata, (text, cleaned), strict=True):
                    if len(automaton):
                        for _, numbers in automaton.iter(read):
                            found.update(numbers)
                return cleaned, sorted(found)

            for batch in batches:
                each = [met(query) for query in batch.column(1).to_pylist()]
                kept = pa.array([i for i, (_, numbers) in enumerate(each) if numbers], pa.int64())
                cleaned = pa.array([text for text, numbers in each if numbers], pa.string())
                numbers = pa.array([numbers for _, numbers in each if numbers], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(kept), batch.column(1).take(kept), cleaned, numbers], names=["qid", "query", "cleaned", "nos"])

        checks = [(no, own[tuple(map(repr, r[:4]))][0], *r[4:]) for no, r in enumerate(part)]
        checks = spark.createDataFrame(checks, T.StructType([T.StructField("no", T.IntegerType()), number, *terms.schema.fields[4:]]))
        named = spark.createDataFrame(list(own.values()), T.StructType([number, *terms.schema.fields[:4]]))
        read = asked.mapInArrow(run, schema).select("qid", "nos", "query", F.lower("query").alias("low"), clean_words(F.col("query")).alias("clean"), "cleaned")
        same = F.col("clean") == F.col("cleaned")
        pairs = read.select("qid", "query", "low", "clean", same.alias("same"), F.explode("nos").alias("no")).join(F.broadcast(checks), "no")  # at most a block of terms
        sure = F.col("same") & F.col("is_phrase") & (F.col("phrase") != "")
        met = pairs.where(F.when(sure, F.lit(True)).otherwise(_hit(F.col("query"), F.col("low"), F.col("clean")))).select("qid", "of").distinct()
        return met.join(F.broadcast(named), "of").select("qid", "rule", "symbols", "frameworks", "place")

    for r in terms.toLocalIterator():
        held.append(r)
        if len(held) == block:
            out.append(scan(held))
            held = []
    if held or not out:
        out.append(scan(held))
    return out[0] if len(out) == 1 else reduce(DataFrame.unionByName, out).distinct()


def mapped_symbols(expanded: DataFrame, most: int = 1 << 30) -> DataFrame:
    """(qid, mapped): the clean names of all met rules, in rule order, each once."""
    ordered = expanded.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("place", "symbols"))).alias("r"))
    names = F.transform(F.flatten(F.transform("r", lambda x: x["symbols"])), lambda s: F.regexp_replace(F.regexp_replace(s, "^@", ""), r"\(.*$", ""))
    return ordered.select("qid", F.slice(F.array_distinct(names), 1, most).alias("mapped"))


def intents(queries: DataFrame, rules: DataFrame) -> DataFrame:
    """(qid, intent, tokens) where all required words of an intent occur in the query, as words or inside it."""
    met = F.forall(F.col("words"), lambda w: F.array_contains(F.split(F.trim(clean_text(F.col("query"))), " "), w) | F.contains(F.lower(F.col("query")), w))
    return queries.crossJoin(F.broadcast(rules)).where(met).select("qid", "intent", "tokens")  # the rule table is small and fixed


def ranked(rows: DataFrame, order: list[Column]) -> DataFrame:
    """Rank from 0 over a list of results that was cut to top-k before."""
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(*order)) - 1)


def fuse(lexical: DataFrame, semantic: DataFrame, key: str, lexical_weight: float = 1.0, semantic_weight: float = 1.0) -> DataFrame:
    """(key, score, rrf, source) from two ranked lists (key, score, rank): weight / (60 + rank + 1) summed; `score` stays the lexical one where there is one."""
    a = lexical.select(key, F.col("score").alias("a_score"), F.col("rank").alias("a_rank"))
    b = semantic.select(key, F.col("score").alias("b_score"), F.col("rank").alias("b_rank"))
    part = lambda rank, w: F.coalesce(w / (RRF_K + F.col(rank) + 1), F.lit(0.0))
    source = F.when(F.col("b_rank").isNull(), "fts").when(F.col("a_rank").isNull(), "semantic").otherwise("hybrid")
    both = a.join(b, key, "full_outer")
    return both.select(key, F.coalesce("a_score", "b_score").alias("score"), (part("a_rank", lexical_weight) + part("b_rank", semantic_weight)).alias("rrf"), source.alias("source"))


def fuse_lists(lists: DataFrame, key: str) -> DataFrame:
    """(key, rrf) from many ranked lists in one frame (key, rank, weight)."""
    return lists.groupBy(key).agg(F.round(F.sum(F.col("weight") / (RRF_K + F.col("rank") + 1)), 5).alias("rrf"), F.count("*").alias("lists"))
