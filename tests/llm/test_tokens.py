import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from palimpsest.llm import chunks, packing, token_counts, token_files

CLIP, BYTES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


def ids(path, texts):
    return [e.ids for e in Tokenizer.from_file(path).encode_batch([t or "" for t in texts], add_special_tokens=False)]


@pytest.mark.parametrize("path,mode", [(CLIP, "words"), (BYTES, "spaced")])
def test_chunks_are_exact(path, mode):
    rnd = random.Random(5)
    parts = ["a", "B", "é", "É", " ", "\n", "\t", "\r\n", ".", ",", "'s", "1", "<|endoftext|>", "<|", " ", "\x1c", "\x00", "̈", "İ", "Σ", "ß", "×", "!!", "§", "漢", "ﬁ", "  "]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 14))) for _ in range(6000)]
    e = chunks.Encoder(path, most=50)
    assert e.mode == mode
    assert [np.frombuffer(x, e.dtype).tolist() for x in e.encode(texts)] == ids(path, texts)


def test_sentence_pieces_are_encoded_whole():
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    e = chunks.Encoder(path)
    texts = ["Hello there  you", "", "ab\ncd"]
    assert e.mode == "whole"
    assert [np.frombuffer(x, e.dtype).tolist() for x in e.encode(texts)] == sentencepiece.SentencePieceProcessor(model_file=path).encode(texts)


def test_counts_and_cache(spark, docs, rows, none, tmp_path):
    cache = f"file://{tmp_path}/cache"
    want = Counter((d, len((t or "").encode()), len(i), len(i) > 2048) for (d, t), i in zip(rows, ids(CLIP, [t for _, t in rows])))
    got = token_counts.count_tokens(docs, CLIP, cache)
    assert Counter(map(tuple, got.collect())) == want
    n = spark.read.parquet(cache).count()
    again = token_counts.count_tokens(docs, CLIP, cache)
    assert Counter(map(tuple, again.collect())) == want
    assert spark.read.parquet(cache).count() == n  # nothing was encoded anew
    # a full cache: no text moves, even without broadcasts
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    plan = token_counts.count_tokens(docs, CLIP, cache)
    assert Counter(map(tuple, plan.collect())) == want and spark.read.parquet(cache).count() == n
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    more = docs.unionByName(docs.limit(1).withColumn("text", token_counts.F.lit("a text that is new")))
    assert token_counts.count_tokens(more, CLIP, cache).count() == len(rows) + 1 and spark.read.parquet(cache).count() == n + 1
    token_counts.count_tokens(docs, BYTES, cache)
    assert spark.read.parquet(cache).count() > n + 1  # another tokenizer has counts of its own
    assert token_counts.count_tokens(none, CLIP, f"{cache}2").count() == 0


def test_packing(docs, rows, none):
    got = packing.pack_powers_of_two(docs, CLIP).collect()
    by_doc = defaultdict(list)
    for r in got:
        by_doc[r["doc_id"]].append(r)
    want = defaultdict(Counter)
    for (d, _), i in zip(rows, ids(CLIP, [t for _, t in rows])):
        i = [*i, 1]
        start = 0
        for n in packing.piece_lengths(len(i), 2048):
            want[d][start, n, zlib.crc32(np.array(i[start : start + n], "<u4").tobytes()), len(i)] += 1
            start += n
        assert start == len(i)
    assert {d: Counter((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in rs) for d, rs in by_doc.items()} == want
    assert sorted(r["sequence_id"] for r in got) == list(range(len(got))) and all(r["offset"] == 0 for r in got)
    lengths = [r["length"] for r in sorted(got, key=lambda r: r["sequence_id"])]
    assert lengths == sorted(lengths, reverse=True)
    assert packing.pack_powers_of_two(none, CLIP).count() == 0


def test_piece_lengths():
    assert packing.piece_lengths(4103, 2048) == [2048, 2048, 4, 2, 1]
    assert all(sum(packing.piece_lengths(n, 2048)) == n and max(packing.piece_lengths(n, 2048)) <= 2048 for n in range(1, 5000))


def test_token_files(spark, docs, rows, none, tmp_path):
    folder = f"file://{tmp_path}/store"
    token_files.write_store(docs, BYTES, 2, folder)
    got = sorted(map(tuple, token_files.read_store(spark, folder).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == sorted(d for d, _ in rows)
    starts = np.cumsum([0] + [r[2] for r in got])
    assert [r[1] for r in got] == starts[:-1].tolist()
    want = Counter((d, len(i) + 1, zlib.crc32(np.array([*i, 2], "<u4").tobytes())) for (d, _), i in zip(rows, ids(BYTES, [t for _, t in rows])))
    assert Counter((r[0], r[2], r[3]) for r in got) == want
    whole = np.concatenate([np.fromfile(f, "<u2") for f in sorted((tmp_path / "store").glob("ids-*.bin"))])
    assert len(whole) == starts[-1]  # flat files, nothing but ids
    token_files.write_store(none, BYTES, 2, folder + "0")
    assert token_files.read_store(spark, folder + "0").count() == 0


def test_least_doc_id_is_not_null(spark, tmp_path):
    least, folder = -(1 << 63), f"file://{tmp_path}/s"
    token_files.write_store(spark.createDataFrame([(least, "a"), (None, "b c"), (least + 1, None)], "doc_id long, text string"), BYTES, 2, folder)
    got = sorted(map(tuple, token_files.read_store(spark, folder).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == [None, least, least + 1] and token_files.read_store(spark, folder).rdd.getNumPartitions() == spark.read.parquet(folder + "/parts").count()


def test_a_tokenizer_that_keeps_capitals(spark, tmp_path):
    """The same vocabulary without lower-casing: capitals are other ids, for chunks and for counts."""
    import json

    with open(CLIP, encoding="utf-8") as f:
        spec = json.load(f)
    spec["normalizer"]["normalizers"] = [n for n in spec["normalizer"]["normalizers"] if n["type"] != "Lowercase"]
    path = str(tmp_path / "cased.json")
    with open(path, "w", encoding="utf-8") as f:
        json.dump(spec, f)
    texts = ["The Quick Brown Fox jumps over Berlin", "the quick brown fox jumps over berlin", "ÉTÉ été", "A\nB  c"]
    e = chunks.Encoder(path)
    assert [np.frombuffer(x, e.dtype).tolist() for x in e.encode(texts)] == ids(path, texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.count_tokens(df, path, f"file://{tmp_path}/cache").collect()}
    assert got == {i: len(x) for i, x in enumerate(ids(path, texts))}
