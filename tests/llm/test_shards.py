import random
import zlib
from collections import defaultdict

from palimpsest.llm import sharding


def plain(sizes, shards):
    loads = [0.0] * shards
    for s in sorted(sizes, reverse=True):
        loads[loads.index(min(loads))] += s
    return sorted(loads)


def test_sizes_as_one_by_one():
    rnd = random.Random(3)
    for _ in range(40):
        classes = sorted(((rnd.choice([rnd.randint(1, 40), rnd.randint(1, 10**7)]), rnd.choice([1, 2, 5, 300, 1000])) for _ in range(6)), reverse=True)
        classes = list({s: (s, c) for s, c in classes}.values())
        loads = [0] * 7
        dealt = [sharding.deal(loads, s, c) for s, c in classes]
        assert all(sum(g) == c for g, (_, c) in zip(dealt, classes))
        assert loads == [sum(g[i] * s for g, (s, _) in zip(dealt, classes)) for i in range(7)]
        assert sorted(loads) == plain([s for s, c in classes for _ in range(c)], 7)


def test_large_sizes_are_exact(spark):
    rnd = random.Random(5)
    sizes = [rnd.randint(66_000, 70_000) for _ in range(240)] + [rnd.randint(1, 50) for _ in range(400)] + [300_000]
    df = spark.createDataFrame(list(enumerate(sizes)), "doc_id long, n int").selectExpr("doc_id", "concat(cast(doc_id as string), repeat('x', n)) AS text")
    loads = sorted(r[1] for r in sharding.assign_shards(df, 24).groupBy("shard").sum("size").collect())
    assert loads == plain([n + len(str(d)) + 8 for d, n in enumerate(sizes)], 24)


def test_shards(docs, rows, none):
    got = sharding.assign_shards(docs, 5).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(d for d, _ in rows)
    text = defaultdict(set)
    for d, t in rows:
        text[d].add(t or "")
    by_shard, by_text = defaultdict(list), defaultdict(set)
    for r in got:
        t = next(iter(text[r["doc_id"]]))
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(t.encode()) + 8, zlib.crc32(t.encode()), "bytes", None)
        by_shard[r["shard"]].append(r)
        by_text[t].add(r["shard"])
    assert all(len(s) == 1 for s in by_text.values())
    for rs in by_shard.values():
        assert sorted(r["slot"] for r in rs) == list(range(len(rs)))
    groups = defaultdict(int)
    for d, t in rows:
        groups[t or ""] += len((t or "").encode()) + 8
    loads = sorted([sum(r["size"] for r in by_shard[i]) for i in range(5)])
    want = plain(groups.values(), 5)
    assert loads == want
    assert sharding.assign_shards(none, 5).count() == 0
