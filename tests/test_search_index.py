import os
import random
import zlib

import pytest

from palimpsest.operators import retrieval, versions
from palimpsest.operators.search_index import SearchIndex
from palimpsest.sources import views

SF = "/root/testdata/sf0.001"
DOCS = "id string, content string"
WORDS = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(120)]


def made(n, seed):
    rnd = random.Random(seed)
    weights = [1 / (i + 1) for i in range(len(WORDS))]
    return [(f"d{i}", " ".join(rnd.choices(WORDS, weights, k=rnd.randint(3, 60)))) for i in range(n)]


def same(index, spark, docs, queries=(["wab", "wdz", "wab"], ["waa"]), ks=(5,)):
    """The index says of every query what a scan of the documents says, ties and all."""
    df = spark.createDataFrame(docs, DOCS)
    for q in queries:
        for k in ks:
            want = [tuple(r) for r in retrieval.bm25(df, q, k).collect()] if q else []
            assert [tuple(r) for r in index.bm25(q, k).collect()] == want
    key = lambda rows: sorted(map(tuple, rows))
    assert key(index.terms().collect()) == key(retrieval.index_terms(df).collect())
    assert [r[0] for r in index.stats().collect()] == [r[0] for r in retrieval.index_stats(df).collect()]
    assert index.stats().first()["n_tokens"] == (retrieval.index_stats(df).first()["n_tokens"] or 0)


def test_changes(spark, tmp_path):
    """Equal to the scan after additions, replacements, removals, and compaction."""
    docs = dict(made(400, 1))
    index = SearchIndex.create(spark, str(tmp_path / "i"), buckets=4, block_docs=16)
    same(index, spark, [])
    index = index.add(spark.createDataFrame(list(docs.items()), DOCS), new=True)
    same(index, spark, list(docs.items()))
    more = dict([*((f"d{i + 350}", t) for i, (_, t) in enumerate(made(100, 2))), ("short", "x"), ("stop", "the and of the and"), ("null", None)])
    docs |= more
    index = index.add(spark.createDataFrame(list(more.items()), DOCS))
    same(index, spark, list(docs.items()), (["wbz", "wcq"], ["nowhere"], []), (1, 1000))
    gone = [f"d{i}" for i in range(0, 450, 3)] + ["unknown", None]
    index = index.remove(spark.createDataFrame([(i,) for i in gone], "id string"))
    docs = {i: t for i, t in docs.items() if i not in gone}
    back = {"d3": "waa wab wac again and again", "d6": "wdz wdz wdz"}
    docs |= back
    index = index.add(spark.createDataFrame(list(back.items()), DOCS))
    same(index, spark, list(docs.items()))
    lost = spark.createDataFrame([*docs.items(), ("d9", "this text is not there now")], DOCS)
    assert [r["id"] for r in index.missing(lost).collect()] == ["d9"]
    index = index.compact()
    index.vacuum()
    assert len(os.listdir(tmp_path / "i" / "data")) == 1
    same(SearchIndex(spark, index.path), spark, list(docs.items()))
    assert index.remove(index.documents().select("id")).bm25(["waa"]).count() == 0


def test_what_a_query_reads(spark, tmp_path):
    """Only the files of the terms' buckets; of the lists only blocks that may hold one of the best."""
    docs = made(3000, 3)
    index = SearchIndex.create(spark, str(tmp_path / "i"), buckets=16, block_docs=32).add(spark.createDataFrame(docs, DOCS), new=True)
    read = index.postings(["waa", "wab"]).inputFiles()
    wanted = {zlib.crc32(t) % 16 for t in (b"waa", b"wab")}
    assert read and {int(f.split("bucket=")[1].split("/")[0]) for f in read} == wanted
    assert len(read) < len(index.postings(WORDS).inputFiles()) / 4
    top = index.bm25(["wab"], 3)
    same(index, spark, docs, [["wab"]], (3,))
    blocks = index.postings(["wab"]).count()
    # rows whose lists the last step opens, from the plan that ran
    top.collect()
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert "LeftSemi" in plan and blocks > 50


def test_blocks_are_skipped(spark, tmp_path, monkeypatch):
    """Few blocks can hold one of the best where lengths differ, and those that cannot are not scored."""
    docs = [(f"d{i:04d}", "target " + "filler " * (i % 400)) for i in range(4000)]
    index = SearchIndex.create(spark, str(tmp_path / "i"), buckets=2, block_docs=32).add(spark.createDataFrame(docs, DOCS), new=True)
    seen = []
    alive = SearchIndex._alive
    monkeypatch.setattr(SearchIndex, "_alive", lambda self, rows: seen.append(rows) or alive(self, rows))
    best = index.bm25(["target"], 5)
    assert [tuple(r) for r in best.collect()] == [tuple(r) for r in retrieval.bm25(spark.createDataFrame(docs, DOCS), ["target"], 5).collect()]
    assert seen[-1].count() < len(docs) / 10


def test_one_version_or_the_other(spark, tmp_path, monkeypatch):
    index = SearchIndex.create(spark, str(tmp_path / "i")).add(spark.createDataFrame(made(20, 4), DOCS))
    late = SearchIndex(spark, index.path)
    index.add(spark.createDataFrame([("n", "wzz wzz wzz new")], DOCS))
    with pytest.raises(versions.Conflict):
        late.add(spark.createDataFrame([("m", "wzz wzz wzz new")], DOCS))
    assert [r["id"] for r in SearchIndex(spark, index.path).bm25(["wzz"]).collect()] == ["n"]


def test_turns(spark, tmp_path):
    turns = views.turns(spark, SF)
    index = SearchIndex.create(spark, str(tmp_path / "i")).add(turns)
    terms = ["thing", "thtion", "ernt", "thing"]
    assert [tuple(r) for r in index.bm25(terms).collect()] == [tuple(r) for r in retrieval.bm25(turns, terms, 16).collect()]
