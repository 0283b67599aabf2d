"""Cleaning and packing of a corpus, each stage on all that the one before it kept.

Quality rules drop documents; of each group of near-duplicates, linked by a similarity of their
sets of 5-word shingles of 0.8 or more, the one with the least doc_id stays; passages of 50 bytes
or more that a document with a smaller doc_id holds are cut out (a document may end up empty, and
stays); documents with a benchmark window go; the rest is packed.
"""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.decontamination import keep_clean
from palimpsest.llm.packing import pack_powers_of_two
from palimpsest.llm.quality_rules import keep_good
from palimpsest.llm.shared import forget, read_table, scratch, shared_path, written
from palimpsest.llm.simhash import keep_one
from palimpsest.llm.suffix_dedup import remove_repeats


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs, read_table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = remove_repeats(docs)
    return cut.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in cut.columns else cut


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_clean(docs, read_table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_powers_of_two(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: Trained scores, components and tokenizers are beyond SQL; tests/llm holds a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = shared_path(spark, name)
        with scratch(spark):  # what a stage wrote on its way goes once its result is written
            docs = written(stage(spark, docs, sf_dir), path)
        if before:
            forget(spark, before)
        before = path
    return docs
