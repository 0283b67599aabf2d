"""Token counts through a digest cache.

A cache row is (tokenizer digest, content digest, n_tokens).  Content is normalised only as
far as the tokenizer itself ignores the difference: where its normaliser folds white space,
runs of spaces, tabs and line ends count as one space.  Only digests that the cache lacks are
encoded, each once, and their counts are appended, so a later call over the same or more
documents encodes what is new.  Digests meet the cache before any text moves: up to MOST_KEYS
misses are broadcast, beyond that both sides are exchanged.

Null text counts as empty (0 tokens); repeated rows and equal texts each get their row; a text may
be of any length that a row holds and is encoded whole; further columns of ``docs`` are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.chunks import chunk_mode, encoder, file_digest
from palimpsest.llm.shared import bounded, give_back, read_table, shared_path, small, stored

CACHE_SCHEMA = "tokenizer string, digest binary, n_tokens long"


def content_digest(text, mode: str):
    """SHA-256 of the normalised content, as 32 bytes."""
    text = F.coalesce(text, F.lit(""))
    if mode == "words":
        text = F.regexp_replace(text, "[ \\t\\r\\n]+", " ")
    return F.unhex(F.sha2(text.cast("binary"), 256))


def _counter(path: str):
    def count(batches):
        e = encoder(path)
        for b in small(batches):
            texts = b.column("text").to_pylist()
            sizes = [len(x) // e.dtype.itemsize for x in e.encode(texts)]
            yield pa.RecordBatch.from_arrays([b.column("digest"), pa.array(sizes, pa.int64())], ["digest", "n_tokens"])
        give_back(encoders=False)

    return count


def count_tokens(docs: DataFrame, tokenizer_path: str, cache_path: str, over: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    version, mode = file_digest(tokenizer_path), chunk_mode(tokenizer_path)
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), content_digest(F.col("text"), mode).alias("digest"))

    known, wanted = _cache(spark, cache_path, version), keyed
    if known is not None:
        # digests alone meet the cache; texts move only where it lacks them
        misses = stored(keyed.select("digest").distinct().join(known, "digest", "left_anti"), "misses")
        wanted = None if misses.isEmpty() else keyed.join(bounded(misses), "digest", "left_semi")
    if wanted is not None:
        (
            wanted.groupBy("digest")
            .agg(F.first("text").alias("text"))
            .mapInArrow(_counter(tokenizer_path), "digest binary, n_tokens long")
            .select(F.lit(version).alias("tokenizer"), "digest", "n_tokens")
            .write.mode("append")
            .parquet(cache_path)
        )
    # written, so that both sides of the join are exchanges of their own and Spark can split a hot digest
    counts = stored(_cache(spark, cache_path, version), "counts")
    sizes = keyed.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "digest")
    return sizes.join(counts, "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > over).alias("over_limit"))


def _cache(spark: SparkSession, path: str, version: str) -> DataFrame | None:
    """One count for each digest of this tokenizer; none where no cache was written yet."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return None
    rows = spark.read.schema(CACHE_SCHEMA).parquet(path).where(F.col("tokenizer") == version)
    return rows.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), shared_path(spark, "token-cache"))
