"""The pipeline against plain versions of its stages, on whole small tables."""

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from cases import bench_words
from palimpsest.llm import packing, quality_rules
from test_near_copies import covered
from test_quality import base
from test_similar_copies import least

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    model = quality_rules.fit_rules(docs, labels)
    rows = [(d, t) for d, t in rows if not base(t)[5] and model.probability([t.encode()])[0] >= quality_rules.KEEP_FROM]
    kept = set(least(rows))
    rows = sorted((d, t) for d, t in rows if d in kept)
    rows = [(d, w[5].decode("utf-8", "ignore")) for (d, _), w in zip(rows, covered(rows))]
    grams = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = bench_words(r["text"])
        grams.update(tuple(w[k : k + 10]) for k in range(max(1, len(w) - 9)) if w)
    clean = []
    for d, t in rows:
        w = bench_words(t)
        if not any(tuple(w[k : k + n]) in grams for n in {len(x) for x in grams} for k in range(len(w) - n + 1)):
            clean.append((d, t))
    assert 0 < len(clean) < len(rows)
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = []
    for d, t in clean:
        n, start = len(tok.encode(t, add_special_tokens=False).ids) + 1, 0
        for k in packing.piece_lengths(n, 2048):
            want.append((d, start, k, n))
            start += k
    got = corpus_pipeline.run(spark, SF).collect()
    assert sorted((r["doc_id"], r["start"], r["length"], r["doc_tokens"]) for r in got) == sorted(want)


def test_odd_and_empty_tables(spark, docs, none, tmp_path):
    for n, table in enumerate((docs, none)):
        path = str(tmp_path / str(n))
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, table, SF)
            if name != "packing":
                assert sorted(out.columns) == sorted(docs.columns)
            out.write.parquet(f"{path}-{name}")
            table = spark.read.schema(out.schema).parquet(f"{path}-{name}")
        assert table.columns[:3] == ["doc_id", "start", "length"] and (table.count() > 0) == (n == 0)
