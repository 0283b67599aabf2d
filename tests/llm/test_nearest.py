import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import nearest
from palimpsest.operators import grid

SF = "/root/testdata/sf0.1"


def plain(rows, asked, k=5):
    """By all pairs: {(query id, vector): [(score, id)]} of usable rows; repeated rows count once."""
    ok = lambda i, v: i is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)
    rows = {(i, tuple(v)) for i, v in rows if ok(i, v)}
    out = {}
    for q in {(i, tuple(v)) for i, v in asked if ok(i, v)}:
        a = np.array(q[1], float)
        near = []
        for i, v in rows:
            if i != q[0] and len(v) == len(a):
                b = np.array(v, float)
                near.append((-(a * b).sum() / (np.sqrt((a * a).sum()) * np.sqrt((b * b).sum())), i))
        out[q] = [(-s, i) for s, i in sorted(near)[:k]]
    return out


def by_query(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["rank"], r["score"], r["vec_id"]))
    return out


def recall(got, want):
    hit = sum(len({i for _, _, i in got.get(q[0], [])} & {i for _, i in w}) for q, w in want.items())
    return hit / max(1, sum(map(len, want.values())))


def test_recall_over_the_whole_table(spark):
    rows = [(r[0], r[1]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()]
    want = plain(rows, [r for r in rows if r[0] % 50 == 0])
    got = by_query(nearest.op11_nearest(spark, SF))
    assert recall(got, want) >= 0.97
    for q, w in want.items():
        assert [r for r, _, _ in got[q[0]]] == [1, 2, 3, 4, 5]
        exact = {i: s for s, i in w}
        for _, score, i in got[q[0]]:
            if i in exact:
                assert score == pytest.approx(exact[i], abs=1e-12)


def test_blocks_change_nothing(spark, monkeypatch):
    """Small blocks, so many cells: answers are as good, and no query or vector is lost."""
    every = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select("vec_id", "embedding")
    rows = [tuple(r) for r in every.collect()]
    small = lambda *a, **b: grid.in_cells(*a[:7], left_rows=4, right_rows=60)
    monkeypatch.setattr(nearest, "in_cells", small)
    asked = every.where("vec_id % 50 = 0")
    got = by_query(nearest.nearest(every, asked))
    assert recall(got, plain(rows, [r for r in rows if r[0] % 50 == 0])) >= 0.97


def test_edges(spark):
    """Nulls, zero and non-finite values, other lengths, copies by the dozen, repeated ids and rows, clashing names."""
    inf, nan = float("inf"), float("nan")
    rows = [(0, [1.0, 0.0]), (50, [1.0, 0.0]), (50, [1.0, 0.0]), (100, [0.0, 2.0]), (150, None), (200, [0.0, 0.0]), (250, [nan, 1.0]), (300, [inf, 1.0]), (350, [None, 1.0]), (None, [1.0, 1.0]), (400, []), (450, [1.0, 2.0, 3.0])]
    rows += [(i, [3.0, 4.0]) for i in range(1, 40)] + [(500, [1.0, 1.0]), (500, [1.0, -1.0]), (7, [1e200, 1e200]), (8, [-1e-200, 0.0])]
    df = spark.createDataFrame([(i, v, 1, "x", [2], 3) for i, v in rows], "vec_id long, embedding array<double>, dim int, ids string, __kind array<int>, n_left int")
    got = by_query(nearest.nearest(df, df.where("vec_id % 50 = 0 AND vec_id <> 500")))
    want = plain([r for r in rows if r[0] not in (7, 8)] + [(7, [1.0, 1.0]), (8, [-1.0, 0.0])], [r for r in rows if r[0] is not None and r[0] % 50 == 0 and r[0] != 500])
    assert {q: [i for _, _, i in g] for q, g in got.items()} == {q[0]: [i for _, i in w] for q, w in want.items() if w}
    assert got[0][0] == (1, 1.0, 50) and 450 not in got  # alone of its length
    twice = nearest.nearest(df, df.where("vec_id = 500")).collect()
    assert sorted(r["rank"] for r in twice) == sorted([1, 2, 3, 4, 5] * 2) and all(r["vec_id"] != 500 for r in twice)
    assert nearest.nearest(df.limit(0), df).count() == 0 and nearest.nearest(df, df.limit(0)).count() == 0
    few = df.where("vec_id IN (0, 100)")
    assert [(r["query_id"], r["vec_id"], r["rank"]) for r in nearest.nearest(few, few).orderBy("query_id").collect()] == [(0, 100, 1), (100, 0, 1)]


def test_collisions_needed():
    """A vector at the radius falls short with the probability stated, in other directions than those that set the number."""
    for dim in (3, 64):
        u = np.random.default_rng(1).standard_normal((20_000, dim))
        u /= np.sqrt((u * u).sum(1))[:, None]
        hits = (np.abs(u @ nearest.lines(dim, 64)) <= nearest.HALF).sum(1)
        assert (hits < nearest.least_collisions(dim, 64, 0.01)).mean() <= 0.02


def test_windows_grow_by_what_is_new():
    """Counts after all steps are those of the last windows counted at once."""
    rng = np.random.default_rng(2)
    index = nearest.Index(rng.standard_normal((300, 8)), 16)
    q = rng.standard_normal(8)
    ends = []
    rows, scores, radius = index.search(q, lambda r, s, at: ends.append(at) or len(r) >= 20, 0.2)
    unit = index.vectors / index.norms[:, None]
    hits = (np.abs(unit @ index.lines - q / np.sqrt((q * q).sum()) @ index.lines) <= nearest.HALF * radius).sum(1)
    assert set(rows) == set(np.flatnonzero(hits >= index.least)) and len(ends) > 1
    assert scores == pytest.approx([unit[r] @ q / np.sqrt((q * q).sum()) for r in rows])


def test_a_column_of_whole_numbers(spark):
    df = spark.createDataFrame([(0, [1, 2]), (1, [2, 4]), (2, [2, 1])], "vec_id int, embedding array<int>")
    got = nearest.nearest(df, df.where(F.col("vec_id") == 0)).orderBy("rank").collect()
    assert [(r["vec_id"], round(r["score"], 12)) for r in got] == [(1, 1.0), (2, 0.8)]
