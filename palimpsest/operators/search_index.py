"""A keyword index that outlives its queries: postings in blocks, kept right as documents come and go.

At a path there are segments, one for each addition:

* ``docs``: id, dl (number of tokens), block and tokens, in folders by a hash of the id;
* ``postings``: a row for each term and block of some hundred documents of like length, with the ids,
  frequencies and lengths, their number, and what bounds the score of any of them: the largest
  frequency and the least length.  They lie in folders by a hash of the term, sorted by term.

A removal writes the ids and what their terms lose, so that document frequencies, the number of
documents and their mean length are those of the living documents alone.  ``versions`` makes each
change whole or not at all.

A query reads the folders of its terms.  The number of documents and their mean length come with the
version, document frequencies from the rows without their lists.  The blocks of the greatest bounds
are scored first; the k-th best of them says which other blocks can hold a better document, and
only the lists of those are read.
"""

from __future__ import annotations

import functools
import operator
import zlib
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.operators import versions
from palimpsest.operators.retrieval import B, K1, indexable

#: Blocks that a query scores before it knows what score it takes to be among the best.
FIRST_BLOCKS = 8
META = ["term", "seg", "block", "n", "n_tokens", "max_tf", "min_dl"]


def _saturated(tf: Column, dl: Column, avgdl: float) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))


class SearchIndex:
    """An index over documents (id, content); of rows with one id one is a document, the one of the greatest content."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.number, self.about = versions.latest(spark, self.path)
        if not self.about:
            raise ValueError(f"no index at {path}")

    @classmethod
    def create(cls, spark: SparkSession, path: str, id_type: str = "string", buckets: int = 16, block_docs: int = 256) -> SearchIndex:
        """An empty index.  Some 100 MB in a segment's bucket is a good size."""
        versions.commit(spark, path.rstrip("/"), 1, {"id_type": id_type, "buckets": buckets, "block_docs": block_docs, "segments": {}, "removals": {}, "n_docs": 0, "n_tokens": 0})
        return cls(spark, path)

    # -- what there is

    def _schema(self, kind: str) -> str:
        i = self.about["id_type"]
        return {
            "docs": f"id {i}, dl int, seg long, block long, tokens array<string>",
            "postings": f"term string, seg long, block long, n long, n_tokens long, max_tf int, min_dl int, list array<struct<id:{i},tf:int,dl:int>>",
            "ids": f"id {i}, before long",
            "terms": "term string, df long, cf long",
        }[kind]

    def _read(self, kind: str, buckets: set[int] | None = None) -> DataFrame:
        """Rows of a kind of all segments or removals, of some buckets or all."""
        of = self.about["segments" if kind in ("docs", "postings") else "removals"]
        found = [f"{self.path}/data/{folder}/{kind}/bucket={b}" for folder, kinds in of.items() for b in kinds[kind] if buckets is None or b in buckets]
        return self.spark.read.schema(self._schema(kind)).parquet(*found) if found else self.spark.createDataFrame([], self._schema(kind))

    def _bucket(self, column: str) -> Column:
        return F.pmod(F.crc32(F.col(column).cast("string")), F.lit(self.about["buckets"])).cast("int")

    def _alive(self, rows: DataFrame) -> DataFrame:
        """Rows (id, seg, ...) without those of documents removed since."""
        if not self.about["removals"]:
            return rows
        gone = self._read("ids").select(F.col("id").alias("__id"), "before")
        return rows.join(gone, (F.col("id") == F.col("__id")) & (F.col("seg") < F.col("before")), "left_anti")

    def documents(self) -> DataFrame:
        """id, dl, tokens of the living documents."""
        return self._alive(self._read("docs")).select("id", "dl", "tokens")

    def missing(self, docs: DataFrame) -> DataFrame:
        """``docs`` (id, ...) that the index does not hold, of those that can be found by a word."""
        return indexable(docs).drop("tokens").join(self._alive(self._read("docs")).select("id"), "id", "left_anti")

    def stats(self) -> DataFrame:
        """One row: n_docs, avg_length, n_tokens."""
        n, t = self.about["n_docs"], self.about["n_tokens"]
        return self.spark.createDataFrame([(n, round(t / n, 6) if n else None, t)], "n_docs long, avg_length double, n_tokens long")

    def _frequencies(self, buckets: set[int] | None = None) -> DataFrame:
        there = self._read("postings", buckets).select("term", F.col("n").alias("df"), F.col("n_tokens").alias("cf"))
        gone = self._read("terms", buckets).select("term", (-F.col("df")).alias("df"), (-F.col("cf")).alias("cf"))
        return there.unionByName(gone)

    def terms(self) -> DataFrame:
        """term, df, cf, without reading a list."""
        return self._frequencies().groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf")).where("df > 0")

    # -- changes

    def _written(self, rows: DataFrame, folder: str, kind: str, *order: str) -> list[int]:
        """Write rows with their ``bucket``; a large bucket is split among tasks."""
        path = f"{self.path}/data/{folder}/{kind}"
        rows.hint("rebalance", "bucket").sortWithinPartitions("bucket", *order).write.partitionBy("bucket").parquet(path)
        return self._buckets_of(path)

    def _buckets_of(self, path: str) -> list[int]:
        p, fs = versions._path(self.spark, f"{path}/bucket=*")
        return sorted(int(s.getPath().getName().partition("=")[2]) for s in (fs.globStatus(p) or []))

    def _segment(self, tokens: DataFrame, folder: str, number: int) -> dict:
        """Write a segment of ``tokens`` (id, tokens); its kinds' buckets, documents and tokens."""
        path = f"{self.path}/data/{folder}/docs"
        dl = F.size("tokens").alias("dl")
        dealt = tokens.select(self._bucket("id").alias("bucket"), "id", dl, "tokens").repartition("bucket").sortWithinPartitions("bucket", "dl", "id")
        # a block is a run of rows of one task, which this one write settles
        row = F.monotonically_increasing_id()
        block = F.shiftleft(F.shiftright(row, 33), 33) + F.floor(F.expr("monotonically_increasing_id() & 8589934591") / self.about["block_docs"])
        dealt.select("bucket", "id", "dl", F.lit(number).cast("long").alias("seg"), block.cast("long").alias("block"), "tokens").write.partitionBy("bucket").parquet(path)
        kept = self._buckets_of(path)
        docs = self.spark.read.schema(self._schema("docs")).parquet(*[f"{path}/bucket={b}" for b in kept]) if kept else self.spark.createDataFrame([], self._schema("docs"))
        tf = docs.select("seg", "block", "id", "dl", F.explode("tokens").alias("term")).groupBy("term", "seg", "block", "id", "dl").agg(F.count("*").cast("int").alias("tf"))
        # a block's documents at most, however common the term
        lists = tf.groupBy("term", "seg", "block").agg(
            F.count("*").alias("n"), F.sum("tf").alias("n_tokens"), F.max("tf").alias("max_tf"), F.min("dl").alias("min_dl"), F.array_sort(F.collect_list(F.struct("id", "tf", "dl"))).alias("list")
        )
        buckets = self._written(lists.withColumn("bucket", self._bucket("term")), folder, "postings", "term", "block")
        n = docs.agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).first()
        return {"docs": kept, "postings": buckets, "n_docs": n[0], "n_tokens": n[1]}

    def _removal(self, gone: DataFrame, folder: str, number: int) -> dict:
        """Write the removal of those of ``gone`` (id) that there are; its kinds' buckets, documents and tokens."""
        wanted = gone.select(F.col("id").cast(self.about["id_type"]).alias("id")).where("id IS NOT NULL").distinct()
        buckets = {r[0] for r in wanted.select(self._bucket("id")).distinct().collect()}
        dead = self._alive(self._read("docs", buckets)).join(wanted, "id", "left_semi").select("id", "dl", "tokens", self._bucket("id").alias("bucket"))
        path = f"{self.path}/data/{folder}/dead"
        dead.write.parquet(path)
        dead = self.spark.read.schema(dead.schema).parquet(path)
        kinds = {"ids": self._written(dead.select("id", F.lit(number).cast("long").alias("before"), "bucket"), folder, "ids", "id")}
        each = dead.select("id", F.explode("tokens").alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf")).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))
        kinds["terms"] = self._written(each.withColumn("bucket", self._bucket("term")), folder, "terms", "term")
        n = dead.agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).first()
        return kinds | {"n_docs": n[0], "n_tokens": n[1]}

    def _commit(self, segments: dict, removals: dict, n_docs: int, n_tokens: int) -> SearchIndex:
        versions.commit(self.spark, self.path, self.number + 1, self.about | {"segments": segments, "removals": removals, "n_docs": n_docs, "n_tokens": n_tokens})
        return SearchIndex(self.spark, self.path)

    def add(self, docs: DataFrame, new: bool = False) -> SearchIndex:
        """The index with ``docs`` (id, content), which take the place of documents of their ids; ``new`` says that there are none such."""
        number = self.number + 1
        folder = versions.folder(self.path, number).rpartition("/")[2]
        one = docs.where(F.col("id").isNotNull()).groupBy(F.col("id").cast(self.about["id_type"]).alias("id")).agg(F.max("content").alias("content"))
        removals, gone = self.about["removals"], {"n_docs": 0, "n_tokens": 0}
        if not new and self.about["segments"]:
            gone = self._removal(docs, folder + "-removed", number)
            removals = removals | {folder + "-removed": gone}
        made = self._segment(indexable(one).select("id", "tokens"), folder, number)
        return self._commit(self.about["segments"] | {folder: made}, removals, self.about["n_docs"] + made["n_docs"] - gone["n_docs"], self.about["n_tokens"] + made["n_tokens"] - gone["n_tokens"])

    def remove(self, gone: DataFrame) -> SearchIndex:
        """The index without the documents of ``gone`` (id)."""
        folder = versions.folder(self.path, self.number + 1).rpartition("/")[2]
        made = self._removal(gone, folder, self.number + 1)
        return self._commit(self.about["segments"], self.about["removals"] | {folder: made}, self.about["n_docs"] - made["n_docs"], self.about["n_tokens"] - made["n_tokens"])

    def compact(self) -> SearchIndex:
        """The same documents in one segment, without what was removed."""
        number = self.number + 1
        folder = versions.folder(self.path, number).rpartition("/")[2]
        made = self._segment(self.documents().select("id", "tokens"), folder, number)
        return self._commit({folder: made}, {}, made["n_docs"], made["n_tokens"])

    def vacuum(self) -> None:
        """Delete the files of versions before this one; nobody may be reading them."""
        versions.vacuum(self.spark, self.path, {*self.about["segments"], *self.about["removals"]})

    # -- queries

    def _none(self) -> DataFrame:
        return self.spark.createDataFrame([], f"id {self.about['id_type']}, score double")

    def postings(self, terms) -> DataFrame:
        """Rows of the terms, from the files of their buckets."""
        buckets = {zlib.crc32(t.encode()) % self.about["buckets"] for t in terms}
        return self._read("postings", buckets).where(F.col("term").isin(sorted(terms)))

    def bm25(self, query_terms: list[str], k: int = 16) -> DataFrame:
        """id, score of the ``k`` best documents, best first; a repeated query term counts as often."""
        times, n = Counter(query_terms), self.about["n_docs"]
        if not times or not n:
            return self._none()
        buckets = {zlib.crc32(t.encode()) % self.about["buckets"] for t in times}
        frequencies = self._frequencies(buckets).where(F.col("term").isin(sorted(times))).groupBy("term").agg(F.sum("df").alias("df"))
        df = {r["term"]: r["df"] for r in frequencies.collect() if r["df"] > 0}  # a row for each term at most
        if not df:
            return self._none()
        avgdl = self.about["n_tokens"] / n
        weight = F.lit(0.0)
        for t, d in df.items():
            weight = F.when(F.col("term") == t, times[t] * F.ln(F.lit((n - d + 0.5) / (d + 0.5) + 1))).otherwise(weight)
        rows = self.postings(df)
        bounds = rows.select(*META).groupBy("seg", "block").agg(F.sum(weight * _saturated(F.col("max_tf"), F.col("min_dl"), avgdl)).alias("bound"))

        def scored(some: DataFrame) -> DataFrame:
            each = some.select("seg", weight.alias("weight"), F.inline("list"))
            per = each.groupBy("seg", "id").agg(F.round(F.sum(F.col("weight") * _saturated(F.col("tf"), F.col("dl"), avgdl)), 6).alias("score"))
            return self._alive(per).select("id", "score").where("score > 0").orderBy(F.desc("score"), "id").limit(k)

        first = bounds.orderBy(F.desc("bound"), "seg", "block").limit(FIRST_BLOCKS).collect()
        least = 0.0
        if len(first) == FIRST_BLOCKS:  # there may be more
            at = functools.reduce(operator.or_, [(F.col("seg") == r["seg"]) & (F.col("block") == r["block"]) for r in first])
            found = scored(rows.where(at)).collect()
            least = found[-1]["score"] if len(found) == k else 0.0
        # scores are rounded, so a bound may be short by half a unit
        able = bounds.where(F.col("bound") >= least - 1e-6).select("seg", "block")
        return scored(rows.join(able, ["seg", "block"], "left_semi"))
