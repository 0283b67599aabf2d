"""Null doc_ids, in every operator."""

import public_tokenizers
import pytest

from palimpsest.llm import decontamination, factor_machine, licenses, packing, quality_rules, sharding, simhash, suffix_dedup, token_counts, token_files

TEXT = "a text that comes twice, long enough to count as a passage of over fifty bytes, with some more words"
CLIP = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("n") / "d")
    spark.createDataFrame([(None, TEXT), (None, None), (3, TEXT), (None, TEXT)], "doc_id long, text string").write.parquet(path)
    return spark.read.parquet(path)


def test_operators(spark, docs, tmp_path):
    labels = spark.createDataFrame([(None, 1, None), (3, None, 0)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, TEXT)], "item_id long, text string")
    token_files.write_store(docs, CLIP, 2, f"file://{tmp_path}/s")
    out = [
        token_counts.count_tokens(docs, CLIP, f"file://{tmp_path}/c"), decontamination.contamination(docs, bench), sharding.assign_shards(docs, 3), licenses.scan_licenses(docs),
        simhash.near_duplicates(docs), factor_machine.score_quality(docs, labels), token_files.read_store(spark, f"file://{tmp_path}/s"), quality_rules.apply_rules(docs, labels), suffix_dedup.repeats(docs),
    ]
    for df in out:
        assert sorted(str(r["doc_id"]) for r in df.collect()) == ["3", "None", "None", "None"]
    assert {r["doc_id"] for r in packing.pack_powers_of_two(docs, CLIP).collect()} == {3, None}


def test_rules(docs, spark):
    groups = {(r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()}
    assert groups == {(3, 3), (None, 3), (None, None)}
    assert sorted((str(r["doc_id"]), r["text"]) for r in simhash.keep_one(docs).collect()) == [("3", TEXT), ("None", None)]
    gone = sorted((str(r["doc_id"]), r["n_removed"] > 0) for r in suffix_dedup.repeats(docs).collect())
    assert gone == [("3", False), ("None", False), ("None", True), ("None", True)]
    clean = decontamination.keep_clean(docs, spark.createDataFrame([(1, TEXT)], "item_id long, text string"))
    assert [(r["doc_id"], r["text"]) for r in clean.collect()] == [(None, None)]


def test_rows_of_one_doc_id_are_judged_each(spark):
    docs = spark.createDataFrame([(1, TEXT), (1, "clean"), (None, TEXT), (None, "clean too"), ("4", "clean as well")], "doc_id string, text string")
    clean = decontamination.keep_clean(docs, spark.createDataFrame([(1, TEXT)], "item_id long, text string"))
    assert sorted(r["text"] for r in clean.collect()) == ["clean", "clean as well", "clean too"]
    assert sorted(r["text"] for r in simhash.keep_one(docs).collect()) == [TEXT, "clean", "clean as well", "clean too"]
