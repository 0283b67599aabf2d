import hashlib
import os
import random
import subprocess
import sys

import numpy as np
import pytest
import xxhash

from cases import lower, space_words
from palimpsest.llm import simhash, suffix_dedup
from palimpsest.llm.components import components


def fingerprint(t):
    w = space_words(lower(t))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), seed=42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(n, linked):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def test_tree_loses_no_pair():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, 120, np.uint64)
    x = np.unique(np.concatenate([base] + [base ^ (np.uint64(1) << rng.integers(0, 64, 120, np.uint64)) for _ in range(9)]))
    want = {(a, b) for a in range(len(x)) for b in np.flatnonzero(np.bitwise_count(x ^ x[a]) <= 2).tolist()}
    assert {(int(a), int(b)) for s, q in simhash.links(x, x, 2, block=16) for a, b in zip(s, q)} == want
    tree = simhash.VantageTree(x[::9], 6)
    rows, leaf, home = tree.visits(x, 2)
    lives, seen = {int(r): int(f) for r, f, h in zip(rows, leaf, home) if h}, set(zip(rows.tolist(), leaf.tolist()))
    assert len(lives) == len(x) and all((b, lives[a]) in seen for a, b in want)
    edges = simhash.spanning_forest(len(x), simhash.links(x, x, 2, block=16))
    assert groups(len(x), edges.tolist()) == groups(len(x), want) and len(edges) == len(x) - len(set(groups(len(x), want)))


def test_components(spark):
    rnd = random.Random(8)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(rnd.randint(200, 400), rnd.randint(200, 400)) for _ in range(150)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = groups(401, edges)
    assert all(got[x] == want[x] for e in edges for x in e if e[0] != e[1])


def test_near_duplicates(docs, rows, none):
    fps = [fingerprint(t) for _, t in rows]
    f = np.array(fps, np.uint64)
    linked = [(i, int(j)) for i in range(len(f)) for j in np.flatnonzero(np.bitwise_count(f ^ f[i]) <= 2)]
    g = groups(len(f), linked)
    least = {}
    for (d, _), r in zip(rows, g):
        least[r] = min(d, least.get(r, d))
    want = sorted((d, f"{x:016x}", least[r]) for (d, _), x, r in zip(rows, fps, g))
    assert sorted(map(tuple, simhash.near_duplicates(docs).collect())) == want
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(set(least.values()))
    assert simhash.near_duplicates(none).count() == 0


def covered(rows, size=50):
    first = {}
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - size + 1):
            first[b[i : i + size]] = min(d, first.get(b[i : i + size], d))
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - size + 1):
            if first[b[i : i + size]] < d:
                gone[i : i + size] = True
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        out.append((d, len(b), int(gone.sum()), int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(b) else 0, hashlib.sha256(kept).hexdigest(), kept))
    return out


def test_repeats(docs, rows, none):
    want = covered(rows)
    assert sorted(map(tuple, suffix_dedup.repeats(docs).collect())) == sorted(w[:5] for w in want) and any(w[2] for w in want)
    cut = suffix_dedup.remove_repeats(docs)
    texts = sorted((d, None if t is None else w[5].decode("utf-8", "ignore")) for (d, t), w in zip(rows, want))
    assert cut.columns == docs.columns
    assert sorted((r["doc_id"], r["text"]) for r in cut.collect() if r["doc_id"]) == [x for x in texts if x[0]]
    assert suffix_dedup.repeats(none).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_repeats_in_small_chunks(spark, tmp_path, monkeypatch, seed):
    rnd = random.Random(seed)
    rows = []
    for _ in range(60):
        alpha = rnd.choice(["a", "ab", "abc é", "abcdefgh ijklmnop"])
        pool = ["ab" * 40, "a" * 90, "the quick brown fox jumps over the lazy dog, and then some more of it again"]
        rows.append((rnd.randint(0, 30), "".join(rnd.choice([rnd.choice(pool), rnd.choice(pool)[5:60], "".join(rnd.choice(alpha) for _ in range(rnd.randint(0, 70)))]) for _ in range(rnd.randint(0, 5)))))
    spark.createDataFrame(rows, "doc_id long, text string").repartition(4).write.parquet(str(tmp_path / "d"))
    got = suffix_dedup.repeats(spark.read.parquet(str(tmp_path / "d"))).collect()
    assert sorted(map(tuple, got)) == sorted(w[:5] for w in covered(rows))


def test_loser_tree():
    rnd = random.Random(6)
    for k in (1, 2, 3, 7, 16):
        lists = [sorted({bytes(rnd.choice(b"ab") for _ in range(12)) for _ in range(rnd.randint(0, 60))}) for _ in range(k)]
        runs = [suffix_dedup.coded_rows(suffix_dedup.front_code(np.frombuffer(b"".join(x), np.uint8).reshape(-1, 12))) for x in lists]
        out = list(suffix_dedup.merge_runs(runs))
        assert [row for _, row, _ in out] == sorted(sum(lists, []))
        for (_, a, _), (_, b, same) in zip(out, out[1:]):
            assert same == next((i for i in range(12) if a[i] != b[i]), 12)


def test_long_texts_in_slices():
    """A long text's anchors come from slices, as if there were none."""
    rng = np.random.default_rng(4)
    text = "".join(rng.choice(list("abcde \n"), 300_000)) + "ab" * 5000 + "a" * 400
    whole = suffix_dedup.Chunk([1, 2], [text, text[1000:]], 50)
    size, suffix_dedup.SLICE_BYTES = suffix_dedup.SLICE_BYTES, 1 << 30
    try:
        one = suffix_dedup.Chunk([1, 2], [text, text[1000:]], 50)
    finally:
        suffix_dedup.SLICE_BYTES = size
    for name in ("place", "first", "last", "doc", "code"):
        assert (getattr(whole, name) == getattr(one, name)).all()


def test_text_of_tens_of_megabytes(tmp_path):
    """A worker that looks for anchors in 40 MB of text stays far below an executor's memory."""
    code = "import random, resource; from palimpsest.llm.suffix_dedup import Chunk; r = random.Random(1); t = ''.join(r.choices('abcdefgh ', k=40_000_000)); n = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss; c = Chunk([1], [t], 50); print(len(c.place), resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - n)"
    anchors, grown = map(int, subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=os.getcwd()).stdout.split())
    assert anchors > 1_000_000 and grown < 700_000  # kB


def test_hot_strings_go_by_single_windows(spark, tmp_path, monkeypatch):
    """A string with more entries than HOT: a common passage that goes on differently in each document."""
    monkeypatch.setattr(suffix_dedup, "HOT", 20)
    rnd = random.Random(2)
    passage = "a passage that very many of the documents hold, word for word, and that is long enough to count"
    rows = [(d, "".join(rnd.choices("abcdef ", k=rnd.randint(0, 60))) + passage + "".join(rnd.choices("abcdef ", k=rnd.randint(0, 60)))) for d in range(200)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(4).write.parquet(str(tmp_path / "d"))
    got = suffix_dedup.repeats(spark.read.parquet(str(tmp_path / "d"))).collect()
    assert sorted(map(tuple, got)) == sorted(w[:5] for w in covered(rows))


def test_fingerprint_by_parts(monkeypatch):
    text = " ".join(random.Random(3).choices(["One", "two", "three,", "four"], k=500)).encode()
    whole = [(simhash.fingerprint(text, k), simhash.shingles(text, k).tolist()) for k in (1, 3, 5)]
    for words in (6, 7, 100):
        monkeypatch.setattr(simhash, "WORDS", words)
        assert [(simhash.fingerprint(text, k), simhash.shingles(text, k).tolist()) for k in (1, 3, 5)] == whole
    assert simhash.fingerprint(b"") == 0 and len(simhash.shingles(b" ")) == 1
