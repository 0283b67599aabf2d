import itertools
from collections import Counter

import duckdb
import pytest

from cases import space_words
from palimpsest.llm import filter_audit


def plain(rows, labels):
    """Every order, applied filter by filter to a list of documents: {(part, order, step): counts}."""
    first = {}
    for d, t, _ in rows:
        if d is not None:
            first[t or ""] = min(d, first.get(t or "", d))
    docs = []
    for d, t, part in rows:
        t = t or ""
        w = space_words(t)
        fails = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t), "D": any(c in "#$%&*|" for c in t), "E": d is not None and d > first[t]}
        docs.append((part or "", fails, any(q == 1 for e, q, _ in labels if e == d and d is not None), any(x == 1 for e, _, x in labels if e == d and d is not None)))
    out, total = {}, Counter()
    parts = {p for p, *_ in docs}
    for order in map("".join, itertools.permutations("ABCDE")):
        left = docs
        for step, f in enumerate(order, 1):
            gone = [x for x in left if x[1][f]]
            for p in parts:
                own = [x for x in gone if x[0] == p]
                total[p, f] += len(own)
                out[p, order, step] = [
                    sum(x[0] == p and not x[1][f] for x in left), len(own), sum(x[0] == p and x[1][f] for x in docs) - len(own), sum(x[0] == p and x[1][f] and sum(x[1].values()) == 1 for x in docs),
                    sum(x[2] for x in own), sum(x[3] for x in own),
                ]
            left = [x for x in left if not x[1][f]]
    return {k: (*v, total[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


COLUMNS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


@pytest.fixture(scope="module")
def tables(rows):
    docs = [(None if i == 3 else d, t, ["web", "book", None, ""][i % 4]) for i, (d, t) in enumerate(rows)]
    labels = [(d, [0, 1, None][i % 3], [1, 0, None][i % 4 % 3]) for i, (d, _) in enumerate(rows)] + [(None, 1, 1), (9, 1, 0), (9, 0, 1)]
    return docs, labels


def test_audit(spark, tables, tmp_path):
    docs, labels = tables
    d = spark.createDataFrame([(i, t, s, 1, True, "m", b"c") for i, t, s in docs], "doc_id long, text string, source string, mask int, good boolean, part string, content binary")
    m = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    d.write.parquet(str(tmp_path / "documents"))
    m.write.parquet(str(tmp_path / "labels"))
    got = filter_audit.audit(filter_audit.document_masks(d, m), "ABCDE").collect()
    assert {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in COLUMNS) for r in got} == plain(docs, labels) and len(got) == 3 * 600
    con = duckdb.connect()
    for name in ("documents", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}/*.parquet'")
    sql = con.execute(f"SELECT part, filter_order, step, {', '.join(COLUMNS)} FROM ({filter_audit.OP12_SQL})").fetchall()
    assert sorted(sql) == sorted((r["part"], r["filter_order"], r["step"], *[r[c] for c in COLUMNS]) for r in got)


def test_empty(spark, none):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(filter_audit.document_masks(none.withColumnRenamed("lang", "source"), labels), "ABCDE").count() == 0


def test_other_filters(spark):
    """Two filters, and names of their own."""
    masks = spark.createDataFrame([("p", m, m == 3, False) for m in (0, 1, 1, 2, 3)], "part string, mask int, good boolean, toxic boolean")
    got = {(r["filter_order"], r["step"]): r for r in filter_audit.audit(masks, "XY").collect()}
    assert [got["XY", 1][c] for c in COLUMNS] == [2, 3, 0, 2, 1, 0, 5] and [got["XY", 2][c] for c in COLUMNS] == [1, 1, 1, 1, 0, 0, 3]
    with pytest.raises(ValueError):
        filter_audit.audit(masks, "XX")


def test_matrices():
    m = filter_audit.outcome_matrices("ABCDE")
    assert all(x.shape == (32, 600) for x in m.values())
    assert (m["removed"].reshape(32, 120, 5).sum(2) == [[int(i > 0)] * 120 for i in range(32)]).all()


def test_very_long_text(spark):
    text = "word " * 400_000 + "A#"
    docs = spark.createDataFrame([(1, text, "s"), (2, text, "s")], "doc_id long, text string, source string")
    labels = spark.createDataFrame([(2, 1, 0)], "doc_id long, quality int, toxic int")
    assert {r["doc_id"]: r["mask"] for r in filter_audit.document_masks(docs, labels).collect()} == {1: 0b01010, 2: 0b11010}
