"""Near-duplicates by 5-word shingles against all pairs, and as the pipeline's stage."""

import random

import numpy as np
import pytest

import corpus_pipeline
from cases import frame, lower, space_words
from pyspark.sql import functions as F

from palimpsest.llm import decontamination, jaccard, simhash
from test_near_copies import groups


def shingles(t):
    w = space_words(lower(t))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def least(rows):
    sets = [shingles(t) for _, t in rows]
    linked = [(i, j) for i in range(len(rows)) for j in range(i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    found = {}
    for (d, _), r in zip(rows, groups(len(rows), linked)):
        found[r] = min(d, found.get(r, d))
    return sorted(set(found.values()))


def edited(n=90, seed=4):
    """Copies of few texts with words exchanged, so that similarities lie on both sides of 0.8."""
    rnd = random.Random(seed)
    bases = [[f"w{rnd.randint(0, 400)}" for _ in range(k)] for k in (6, 40, 120, 300)]
    out = []
    for d in range(n):
        words = list(rnd.choice(bases))
        for _ in range(rnd.randint(0, max(1, len(words) // 25))):
            words[rnd.randrange(len(words))] = f"x{d}"
        out.append((d, " ".join(words)))
    return out


def test_all_pairs(spark, docs, rows, none):
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == least(rows)
    copies = edited()
    got = sorted(r["doc_id"] for r in simhash.keep_one(frame(spark, copies)).collect())
    assert got == least(copies) and 4 < len(got) < len(copies)
    assert simhash.keep_one(none).count() == 0


def test_columns_of_clashing_names(spark, tmp_path):
    texts = [(1, "one two three four five six"), (2, "one two three four five six"), (3, "another text of its own with more words")]
    names = ["doc_id", "text", "__row", "__FILE", "__row_", "id", "a.b", "bands"]
    df = spark.createDataFrame([(d, t, f"r{d}", d, d * 2, "i", "x", "y") for d, t in texts], names)
    df.write.parquet(str(tmp_path / "d"))
    bench = spark.createDataFrame([(1, texts[0][1])], "item_id long, text string")
    for docs in (df, spark.read.parquet(str(tmp_path / "d"))):
        kept = simhash.keep_one(docs)
        assert kept.columns == names and sorted(tuple(r)[:5] for r in kept.collect()) == [(d, t, f"r{d}", d, d * 2) for d, t in texts if d != 2]
        clean = decontamination.keep_clean(docs, bench)
        assert clean.columns == names and [tuple(r)[:5] for r in clean.collect()] == [(3, texts[2][1], "r3", 3, 6)]


def test_repeated_and_null_ids(spark):
    a, b = "one two three four five six", "another text of its own with more words"
    kept = simhash.keep_one(spark.createDataFrame([(1, a), (1, b), (1, b), (2, a), (None, a), (None, None)], "doc_id long, text string"))
    assert sorted((str(r["doc_id"]), str(r["text"])) for r in kept.collect()) == sorted([("1", a), ("1", b), ("None", "None")])
    # rows are judged, not doc_ids: the second text of doc_id 2 is a copy although the first is not
    kept = simhash.keep_one(spark.createDataFrame([(1, a), (2, b), (2, a)], "doc_id long, text string"))
    assert sorted((r["doc_id"], r["text"]) for r in kept.collect()) == [(1, a), (2, b)]


def test_stage_takes_copies_beyond_two_bits(spark):
    words = [f"word{i}" for i in range(120)]
    texts = [" ".join(words)] + [" ".join(w if i != at else "other" for i, w in enumerate(words)) for at in (20, 60)]
    far = [bin(simhash.fingerprint(texts[0].encode()) ^ simhash.fingerprint(t.encode())).count("1") for t in texts[1:]]
    assert min(far) > 2
    kept = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "")
    assert [r["doc_id"] for r in kept.collect()] == [0]


@pytest.mark.parametrize("seed", range(4))
def test_blocks(seed):
    """A product of matrices finds what pair by pair comparison does."""
    rng = np.random.default_rng(seed)
    base = [rng.choice(1 << 40, n, replace=False).astype(np.uint64) for n in (20, 60, 200)]
    sets = []
    for _ in range(120):
        s = base[rng.integers(0, 3)]
        s = s[rng.random(len(s)) > rng.choice([0.02, 0.1, 0.2])]
        sets.append(np.unique(np.concatenate([s, rng.choice(1 << 40, rng.integers(0, 6)).astype(np.uint64)])))
    roots = rng.integers(0, 90, 120)
    want = [(i, j) for i in range(120) for j in range(i) if jaccard.alike(sets[i], sets[j]) >= 0.8]
    apart = [(i, j) for i, j in want if roots[i] != roots[j]]
    found = jaccard.links(sets, roots, 0.8, width=64).tolist()
    joined = [(int(np.flatnonzero(roots == r)[0]), i) for i, r in enumerate(roots)]
    assert {tuple(sorted(p)) for p in found} <= {tuple(sorted(p)) for p in apart}
    assert groups(120, joined + found) == groups(120, joined + apart) and 0 < len(found) < len(apart)


def test_large_group_block_by_block(spark, monkeypatch):
    """Bands of many blocks."""
    monkeypatch.setattr(jaccard, "BLOCK_BYTES", 4096)
    copies = edited(160, 9)
    got = sorted(r["doc_id"] for r in simhash.keep_one(frame(spark, copies)).collect())
    assert got == least(copies)


def test_many_small_sets_of_one_band(spark, monkeypatch):
    """Sets that share shingles but too few: no matrix over all of them, in one block or in many."""
    sets = [np.sort(np.array([1, 2, 3, 4, 100 + i], np.uint64)) for i in range(100_000)]
    assert len(jaccard.links(sets, np.arange(len(sets)), 0.8)) == 0
    monkeypatch.setattr(jaccard, "BLOCK_SETS", 50)
    some = sets[:299] + [np.array([1, 2, 3, 4], np.uint64)]  # the last is like each of them, they are not like each other
    stored = spark.createDataFrame([(i, bytearray(s.tobytes()), len(s)) for i, s in enumerate(some)], "id long, hashes binary, n long")
    placed = stored.select(F.lit(7).cast("long").alias("band"), "id", "n", F.col("id").alias("root"))
    got = {tuple(r) for r in jaccard._by_blocks(placed, stored.select("id", "hashes"), 0.8).collect()}
    assert {min(p) for p in got} == set(range(299)) and {max(p) for p in got} == {299}
