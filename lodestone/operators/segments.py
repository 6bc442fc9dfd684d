"""A stored full-text index that is kept in step with its rows: immutable segments, tombstones, and blocks with bounds for a top-k that reads little.

Each change writes one segment, a folder with
  lengths   (doc, dl, print, bucket, ord)  a row a document; buckets hold up to 128 documents of about one length
  postings  (term, bucket, col, docs, counts, places)  in this order, docs being places in the bucket: a row for a term of a bucket, not for a word of a text
  blocks    (term, kind, bucket, n, most, least_dl)  for each term (kind 0) and prefix of up to six letters (kind 1): documents, and most occurrences a column
  gone      (doc, seg)                     documents of older segments that this one replaces or deletes
  minus     (term, kind, seg, n)           how many documents with a term that took away
and then a manifest that names the live segments and the totals.  Readers follow the highest manifest, so they see a change whole or not at
all; a writer that finds its number taken gets an error.  Small segments are merged into larger ones, which drops what is gone.

Scores are those of a fresh build: totals and document counts are kept by differences, and only live documents are scored.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import inverted
from lodestone.operators.fulltext import Phrase, group_of, occurrences, part, plan_query, scored
from lodestone.sources import store
from lodestone.sources.catalog import bounded_batches

_SHAPE = {"lengths": ("doc", "dl", "print", "bucket", "ord"), "postings": ("term", "bucket", "col", "docs", "counts", "places"), "blocks": ("term", "kind", "bucket", "n", "most", "least_dl")}
_FIRST = 32  # buckets read before the bound is known
_MOST_LISTED = 8192  # buckets named in a filter; beyond that they are joined


class ChangedError(RuntimeError):
    """Another writer committed first."""


@dataclass
class SegmentedIndex:
    spark: SparkSession
    path: str
    key: str
    columns: Sequence[str]
    prefixes: int = 6
    factor: int = 4  # a run of newest segments is merged with an older one that is at most so many times as large
    _hadoop: object = field(init=False, repr=False)

    def __post_init__(self):
        jvm = self.spark.sparkContext._jvm
        self._hadoop = jvm.org.apache.hadoop.fs
        at = self._hadoop.Path(self.path)
        self._files = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    # Manifests

    def manifest(self) -> dict:
        """The newest version; an index that holds nothing is version 0."""
        folder = self._hadoop.Path(f"{self.path}/versions")
        found = [s.getPath() for s in self._files.listStatus(folder)] if self._files.exists(folder) else []
        named = {int(p.getName()[:-5]): p for p in found if p.getName().endswith(".json")}
        if not named:
            return {"version": 0, "segments": [], "rows_all": 0, "dl_all": 0}
        stream = self._files.open(named[max(named)])
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, manifest: dict) -> None:
        folder = f"{self.path}/versions"
        temp, final = self._hadoop.Path(f"{folder}/{uuid.uuid4().hex}.tmp"), self._hadoop.Path(f"{folder}/{manifest['version']:010d}.json")
        out = self._files.create(temp, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if self._files.exists(final) or not self._files.rename(temp, final):
            self._files.delete(temp, False)
            raise ChangedError(f"version {manifest['version']} of {self.path} is there already")

    def expire(self, keep: int = 2) -> None:
        """Deletes versions older than the newest `keep`, and segments that no kept version names."""
        folder = self._hadoop.Path(f"{self.path}/versions")
        names = sorted(s.getPath().getName() for s in self._files.listStatus(folder) if s.getPath().getName().endswith(".json"))
        live = set()
        for name in names[-keep:]:
            text = self.spark.read.text(f"{self.path}/versions/{name}", wholetext=True).first()[0]
            live |= {s["folder"] for s in json.loads(text)["segments"]}
        for name in names[:-keep]:
            self._files.delete(self._hadoop.Path(f"{self.path}/versions/{name}"), False)
        for s in self._files.listStatus(self._hadoop.Path(self.path)):
            if s.getPath().getName().startswith("seg-") and s.getPath().getName() not in live:
                self._files.delete(s.getPath(), True)

    # Tables of live segments

    def _read(self, name: str, segments: Sequence[dict]) -> DataFrame | None:
        out = None
        for s in segments:
            one = self.spark.read.parquet(f"{self.path}/{s['folder']}/{name}")
            one = one if name in ("gone", "minus") else one.withColumn("seg", F.lit(s["order"]))
            one = one.withColumn("by", F.lit(s["order"]))
            out = one if out is None else out.unionByName(one)
        return out

    def live(self, manifest: dict | None = None) -> DataFrame:
        """(seg, doc, dl, print, bucket) of the documents that nothing replaced."""
        segments = (manifest or self.manifest())["segments"]
        if not segments:
            return self.spark.createDataFrame([], "seg int, doc long, dl int, print string, bucket long, ord int")
        lengths = self._read("lengths", segments).drop("by")
        return lengths.join(self._read("gone", segments).select("seg", "doc"), ["seg", "doc"], "left_anti")

    # Changes

    def _shaped(self, rows: DataFrame) -> DataFrame:
        return rows.select(F.col(self.key).alias("doc"), *(F.col(c).alias(f"c{i}") for i, c in enumerate(self.columns)))

    def _print(self) -> Column:
        values = [F.coalesce(F.col(f"c{i}"), F.lit("")) for i in range(len(self.columns))]
        return F.md5(F.concat_ws(",", *(F.length(v).cast("string") for v in values), *values))

    def _write(self, staged: DataFrame, gone: DataFrame, minus: DataFrame, order: int) -> dict:
        """A segment from the rows of its tables (inverted.STAGED), each of which one shuffle brings in order; gone and minus tell what it takes from older ones."""
        folder = f"seg-{order:06d}-{uuid.uuid4().hex}"
        at = f"{self.path}/{folder}"
        staged.write.parquet(f"{at}/staged")  # so that texts are turned round once, and sampling for the ranges reads keys alone
        staged = self.spark.read.parquet(f"{at}/staged")
        for name, columns in _SHAPE.items():
            rows, by = staged.where(F.col("what") == name).select(*columns), [c for c in ("term", "kind", "bucket", "col", "ord") if c in columns]
            out = rows.repartitionByRange(*by).sortWithinPartitions(*by).write
            if name == "postings":
                out = out.option("parquet.page.row.count.limit", 32).option("parquet.page.size.row.check.min", 8)
            out.parquet(f"{at}/{name}")
        store.delete(self.spark, f"{at}/staged")
        lengths = self.spark.read.parquet(f"{at}/lengths")
        if lengths.groupBy("doc").agg(F.count("*").alias("n")).where("n > 1 OR doc IS NULL").limit(1).count():
            raise ValueError(f"{self.key} must be there and unlike in each row")
        gone.write.parquet(f"{at}/gone")
        minus.write.parquet(f"{at}/minus")
        rows, dl = lengths.agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).first()
        return {"order": order, "folder": folder, "rows": rows, "dl": dl}

    def _staged(self, doc: DataFrame) -> str:
        return inverted.STAGED.format(doc.schema["doc"].dataType.simpleString())

    def update(self, rows: DataFrame | None = None, removed: DataFrame | None = None) -> None:
        """Rows (key and columns) are added, or replace those of their keys; keys in `removed` go.  One segment is written; older ones are read, not changed."""
        manifest = self.manifest()
        order = 1 + max((s["order"] for s in manifest["segments"]), default=0)
        if rows is None:
            rows = self.spark.createDataFrame([], ", ".join([f"{self.key} long", *(f"{c} string" for c in self.columns)]))
        new = self._shaped(rows)
        ids = new.select("doc") if removed is None else new.select("doc").unionByName(removed.select(F.col(self.key).alias("doc")))
        gone = self.live(manifest).join(ids, "doc", "left_semi").select("seg", "doc", "dl", "bucket", "ord")
        taken, dl = gone.agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).first()
        if taken:
            left = gone.groupBy("seg", "bucket").agg(F.collect_list("ord").alias("left"))  # at most a bucket's documents
            met = self._read("postings", manifest["segments"]).select("seg", "bucket", "term", "docs").join(left, ["seg", "bucket"])
            met = met.select("seg", "bucket", "term", F.array_intersect("docs", "left").alias("docs")).where(F.size("docs") > 0)
            minus = met.groupBy("seg", "bucket").applyInArrow(inverted.lost(self.prefixes), "seg int, term string, kind int, n long")
            minus = minus.groupBy("seg", "term", "kind").agg(F.sum("n").alias("n"))
        else:
            minus = self.spark.createDataFrame([], "seg int, term string, kind int, n long")
        bounded_batches(self.spark)
        lists = new.select("doc", self._print().alias("print"), *(T.tokens(F.col(f"c{i}")).alias(f"t{i}") for i in range(len(self.columns))))
        staged = lists.mapInArrow(inverted.by_bucket(len(self.columns), self.prefixes), self._staged(new))
        segment = self._write(staged, gone.select("seg", "doc"), minus, order)
        totals = {"rows_all": manifest["rows_all"] - taken + segment["rows"], "dl_all": manifest["dl_all"] - dl + segment["dl"]}
        self._commit({"version": manifest["version"] + 1, "segments": [*manifest["segments"], segment], **totals})
        self.merge()

    def difference(self, rows: DataFrame) -> DataFrame:
        """(doc, state) of the documents in which index and rows differ: new, changed or gone."""
        have = self.live().select("doc", F.col("print").alias("had"))
        want = self._shaped(rows).select("doc", self._print().alias("has"))
        state = F.when(F.col("had").isNull(), "new").when(F.col("has").isNull(), "gone").when(F.col("had") != F.col("has"), "changed")
        return have.join(want, "doc", "full").select("doc", state.alias("state")).where("state IS NOT NULL")

    def sync(self, rows: DataFrame) -> dict[str, int]:
        """Brings the index in step with a table by writing what differs; returns how many documents were new, changed and gone."""
        found = f"{self.path}/differences/{uuid.uuid4().hex}"
        self.difference(rows).write.parquet(found)
        differs = self.spark.read.parquet(found)
        counts = {r["state"]: r["n"] for r in differs.groupBy("state").agg(F.count("*").alias("n")).collect()}
        if counts:
            fresh = rows.join(differs.where("state <> 'gone'").select(F.col("doc").alias(self.key)), self.key, "left_semi")
            self.update(fresh, differs.where("state = 'gone'").select(F.col("doc").alias(self.key)))
        self._files.delete(self._hadoop.Path(found), True)
        return counts

    def merge(self, everything: bool = False) -> int:
        """Merges the newest segments with each older one that is not `factor` times as large as all newer together; returns how many segments were merged."""
        manifest = self.manifest()
        segments = manifest["segments"]
        at, size = len(segments) - 1, segments[-1]["rows"] if segments else 0
        while at > 0 and (everything or segments[at - 1]["rows"] <= self.factor * size):
            at -= 1
            size += segments[at]["rows"]
        chosen = segments[max(at, 0) :]
        if len(chosen) < 2:
            return 0
        oldest, order = chosen[0]["order"], chosen[-1]["order"]
        live = self.live({"segments": chosen})
        buckets = live.groupBy("seg", "bucket").agg(F.min("dl").alias("least"), F.count("*").cast("int").alias("n")).select("seg", "bucket", "least", "n")
        places = ("least", "seg", "bucket")
        fresh = buckets.repartitionByRange(*places).sortWithinPartitions(*places).mapInArrow(inverted.packed(), "fresh long, seg int, bucket long")
        at = f"{self.path}/differences/{uuid.uuid4().hex}"
        fresh.write.parquet(at)
        fresh = lambda: self.spark.read.parquet(at)  # noqa: E731  a row a bucket
        postings = self._read("postings", chosen).select("term", "seg", "bucket", "col", "docs", "counts", "places").join(fresh(), ["seg", "bucket"])
        live = live.select("seg", "bucket", "ord", "doc", "dl", "print").join(fresh(), ["seg", "bucket"])
        staged = postings.groupBy("fresh").cogroup(live.groupBy("fresh")).applyInArrow(inverted.moved(len(self.columns), self.prefixes), self._staged(live))
        gone = self._read("gone", chosen).where(F.col("seg") < oldest).select("seg", "doc")
        minus = self._read("minus", chosen).where(F.col("seg") < oldest).groupBy("seg", "term", "kind").agg(F.sum("n").alias("n"))
        merged = self._write(staged, gone, minus, order)
        store.delete(self.spark, at)
        self._commit({**manifest, "version": manifest["version"] + 1, "segments": [*segments[: len(segments) - len(chosen)], merged]})
        return len(chosen)

    # Search

    def search(self, weights: Mapping[str, float], groups: Sequence[Sequence[Phrase]], match: str = "all") -> DataFrame:
        """(doc, score, hits) of every live document that matches, as fulltext.search_index."""
        manifest = self.manifest()
        phrases = [p for group in groups for p in group]
        live = self.live(manifest)
        if not phrases or not manifest["segments"]:
            return live.limit(0).select("doc", F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("hits"))
        tf = self._met(self._read("postings", manifest["segments"]), live, phrases, weights)
        df = tf.groupBy("i").agg(F.count("*").alias("n"))
        return scored(self._with_totals(tf.join(F.broadcast(df), "i"), manifest), groups, match)  # df has a row a phrase

    def _met(self, postings: DataFrame, live: DataFrame, phrases: Sequence[Phrase], weights: Mapping[str, float]) -> DataFrame:
        """(doc, dl, i, f) of live documents."""
        found = occurrences(self._named(postings), phrases, weights, ("seg", "bucket")).withColumnRenamed("doc", "ord")
        return found.join(live.select("seg", "bucket", "ord", "doc", "dl"), ["seg", "bucket", "ord"]).select("doc", "dl", "i", "f")

    def _named(self, postings: DataFrame) -> DataFrame:
        return postings.withColumn("col", F.element_at(F.array(*map(F.lit, self.columns)), F.col("col") + 1))

    def _with_totals(self, rows: DataFrame, manifest: dict) -> DataFrame:
        mean = manifest["dl_all"] / manifest["rows_all"] if manifest["rows_all"] else 0.0
        return rows.withColumn("rows_all", F.lit(manifest["rows_all"])).withColumn("mean", F.lit(float(mean)))

    def _bounded(self, phrase: Phrase) -> bool:
        """Whether blocks hold the document count of a phrase."""
        return len(phrase.words) == 1 and (not phrase.prefix or len(phrase.words[0]) <= self.prefixes)

    def bounds(self, weights: Mapping[str, float], groups: Sequence[Sequence[Phrase]], match: str, manifest: dict) -> tuple[DataFrame, list[int]]:
        """(seg, bucket, most): no document of the bucket scores more; and for each phrase the live documents that hold it."""
        phrases = [p for group in groups for p in group]
        tests = [(F.col("kind") == int(p.prefix)) & (F.col("term") == p.words[0]) for p in phrases]
        wanted = F.lit(False)
        for test in tests:
            wanted = wanted | test
        which = F.explode(F.array_compact(F.array(*(F.when(t, i) for i, t in enumerate(tests))))).alias("i")
        blocks = self._read("blocks", manifest["segments"]).where(wanted)
        blocks = blocks.select("seg", "bucket", "n", "least_dl", "most", which)
        minus = self._read("minus", manifest["segments"]).where(wanted).select(which, (-F.col("n")).alias("n"))
        counted = {r["i"]: r["n"] for r in blocks.select("i", "n").unionByName(minus).groupBy("i").agg(F.sum("n").alias("n")).collect()}  # a row a phrase
        n = [counted.get(i, 0) for i in range(len(phrases))]
        f = sum((F.get("most", F.lit(i)) * F.lit(float(weights.get(c, 0.0))) for i, c in enumerate(self.columns)), F.lit(0.0))
        rows = self._with_totals(blocks.withColumn("f", f).where("f > 0").withColumn("df", F.element_at(F.array(*map(F.lit, n)), F.col("i") + 1)), manifest)
        best = part(F.col("df"), F.col("rows_all"), F.col("f"), F.col("least_dl"), F.col("mean"))
        out = rows.groupBy("seg", "bucket").agg((F.sum(best) * (1 + 1e-9)).alias("most"), F.countDistinct(group_of(groups)).alias("hits"))
        return (out.where(F.col("hits") == len(groups)) if match == "all" else out).select("seg", "bucket", "most"), n

    def top(self, weights: Mapping[str, float], groups: Sequence[Sequence[Phrase]], k: int, match: str = "all") -> DataFrame:
        """(doc, score) of the best k: the buckets of the highest bounds are scored first, then only those whose bound reaches the k-th score.

        Phrases of several words and prefixes longer than the stored ones have no bounds; with one of them every match is scored.
        """
        manifest = self.manifest()
        phrases = [p for group in groups for p in group]
        if not phrases or not manifest["segments"] or not all(map(self._bounded, phrases)):
            return self.search(weights, groups, match).select("doc", "score").orderBy(F.col("score").desc(), "doc").limit(k)
        bounds, n = self.bounds(weights, groups, match, manifest)
        first = bounds.orderBy(F.col("most").desc(), "seg", "bucket").limit(_FIRST).collect()
        found = [r["score"] for r in self._exact(first, weights, groups, match, n, manifest).orderBy(F.col("score").desc()).limit(k).collect()]
        least = found[-1] if len(found) == k else 0.0
        reached = bounds.where(F.col("most") >= least)
        listed = reached.limit(_MOST_LISTED + 1).collect() if len(first) == _FIRST else first
        buckets = listed if len(listed) <= _MOST_LISTED else reached
        return self._exact(buckets, weights, groups, match, n, manifest).orderBy(F.col("score").desc(), "doc").limit(k)

    def _exact(self, buckets, weights: Mapping[str, float], groups: Sequence[Sequence[Phrase]], match: str, n: Sequence[int], manifest: dict) -> DataFrame:
        """(doc, score) of the live documents of some buckets, a list of rows or a DataFrame (seg, bucket)."""
        phrases = [p for group in groups for p in group]
        postings = lengths = None
        for s in manifest["segments"]:
            own = [b["bucket"] for b in buckets if b["seg"] == s["order"]] if isinstance(buckets, list) else None
            if own == []:
                continue
            chosen = F.col("bucket").isin(own) if own else F.lit(True)
            p, d = (self._read(name, [s]).where(chosen).drop("by") for name in ("postings", "lengths"))
            postings, lengths = (p, d) if postings is None else (postings.unionByName(p), lengths.unionByName(d))
        if postings is None:
            return self.live(manifest).limit(0).select("doc", F.lit(0.0).alias("score"))
        if not isinstance(buckets, list):
            postings, lengths = (x.join(buckets.select("seg", "bucket"), ["seg", "bucket"], "left_semi") for x in (postings, lengths))
        live = lengths.join(self._read("gone", manifest["segments"]).select("seg", "doc"), ["seg", "doc"], "left_anti")
        tf = self._met(postings, live, phrases, weights)
        df = F.element_at(F.array(*map(F.lit, n)), F.col("i") + 1)
        return scored(self._with_totals(tf.withColumn("n", df), manifest), groups, match).select("doc", "score")

    def find_top(self, weights: Mapping[str, float], query: str, k: int) -> DataFrame:
        """The best k of what fulltext.search finds: documents with all tokens of the query, or, if there are none, those with any at half the score."""
        groups = plan_query(query)
        every = self.top(weights, groups, k)
        if len(groups) < 2 or not every.isEmpty():
            return every
        return self.top(weights, groups, k, "any").withColumn("score", F.col("score") * 0.5)
