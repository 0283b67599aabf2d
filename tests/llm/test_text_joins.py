import hashlib

import duckdb
import pytest

from cases import bench_words
from palimpsest.llm import decontamination, licenses


def benchmark(spark, rows):
    texts = dict(rows)
    long = texts[3].split(" ")
    items = [(0, " ".join(long[5:30])), (1, " ".join(long[8:18]).upper()), (2, "one, TWO"), (3, ""), (4, None), (5, "!!"), (6, "no such words here at all in any of the texts"), (1, "ONE two"), (None, " ".join(long[50:61]))]
    return items, spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, row int")


@pytest.mark.parametrize("limit", [64 << 20, 0])
def test_decontamination(spark, docs, rows, none, limit):
    items, bench = benchmark(spark, rows)
    windows = {}
    for i, t in items:
        w = bench_words(t)
        for k in range(max(1, len(w) - 9)) if w else ():
            windows.setdefault(tuple(w[k : k + 10]), set()).add("" if i is None else str(i))
    want = []
    for d, t in rows:
        w, hit, found = bench_words(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit.update(range(k, k + n))
                    found |= windows[tuple(w[k : k + n])]
        want.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    got = decontamination.contamination(docs, bench, broadcast_bytes=limit).drop("hit_spans")
    assert sorted(map(tuple, got.collect())) == sorted(want) and any(r[-1] for r in want)
    clean = decontamination.keep_clean(docs, bench)
    assert clean.columns == docs.columns and sorted(r["doc_id"] for r in clean.collect()) == sorted(d for d, *_, bad in want if not bad)
    assert decontamination.contamination(none, bench).count() == 0
    assert not any(r["contaminated"] for r in decontamination.contamination(docs, bench.limit(0)).collect())


def test_table_grows_with_the_benchmark(spark):
    """A million windows: the table of bits lets few others pass, and the hits are right."""
    items = spark.range(1000).selectExpr("id AS item_id", "array_join(transform(sequence(0, 1008), i -> concat('w', id * 2000 + i)), ' ') AS text")
    docs = spark.range(300).selectExpr("id AS doc_id", "array_join(transform(sequence(0, 30), i -> concat('w', id * 2000 + if(id % 3 = 0, i, i * 2))), ' ') AS text")
    windows = decontamination.benchmark_windows(items).cache()
    assert windows.count() == 1_000_000
    tried, _ = decontamination._tried(decontamination.with_row_key(docs), windows, 10)
    assert tried.where("length > 0").count() < 100 * 22 + 1000
    got = {r["doc_id"]: (r["n_hit"], r["n_items"]) for r in decontamination.contamination(docs, items).collect()}
    assert got == {d: (31, 1) if d % 3 == 0 else (0, 0) for d in range(300)}


def test_licenses(spark, docs, rows, none, monkeypatch):
    mit, files = dict(licenses.KNOWN)["MIT"], dict(reversed(licenses.common_licenses()))
    texts = [
        (1, mit), (2, "  Copyright (c) 2020 A\n" + mit.replace("sublicense", "sub-licence").upper() + "\nAll rights reserved."), (3, mit + " and more"), (4, None), (5, "Copyright 2020"), (6, ""),
        (7, "licensed under the APACHE licence version 2 0"), (1, mit), (8, files["GPL-3.0"].upper()), (9, files["Apache-2.0"][: files["Apache-2.0"].index("APPENDIX")]), (10, "some prose\n\n# Released under the MIT Licence\nmore, licensed under CC BY-NC 4.0"),
        (11, "# A tool\n\nIts use is free.\n" + mit.replace(". ", ".\n// ") + "\n\n## Next\n" + files["BSD-3-Clause"].replace("distribution", "dis-tribution", 1)),
        (12, "see below: " + files["ISC"].replace(" ", "\n * ") + " " + files["Zlib"] + " end"), (13, files["Zlib"][:-30]), (14, " ".join(files["ISC"].split()[:40] * 3)),
    ]
    df = spark.createDataFrame([(d, t, "x") for d, t in texts], "doc_id long, text string, license_id string")
    want = [
        (1, "MIT", "", "MIT"), (1, "MIT", "", "MIT"), (2, "MIT", "", "MIT"), (3, "", "", "MIT"), (4, "", "", ""), (5, "", "", ""), (6, "", "", ""), (7, "Apache-2.0 notice", "Apache-2.0 notice", ""),
        (8, "GPL-3.0", "", "GPL-3.0"), (9, "Apache-2.0", "", "Apache-2.0"), (10, "", "MIT notice", ""), (11, "", "", "MIT"), (12, "", "", "ISC,Zlib"), (13, "", "", ""), (14, "", "", ""),
    ]
    for most in (licenses.MOST_KEYS, 40):
        monkeypatch.setattr(licenses, "MOST_KEYS", most)
        got = sorted((r["doc_id"], r["license_id"] or "", r["notices"], r["blocks"], r["is_license"]) for r in licenses.scan_licenses(df).collect())
        assert got == [(*w, any(w[1:])) for w in want]
    assert licenses.scan_licenses(docs).count() == len(rows) and licenses.scan_licenses(none).count() == 0


def test_canonical_form(spark):
    """Clauses, other scripts and words that only hold a spelling."""
    form = lambda *texts: [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(licenses.canonical(licenses.F.col("t"))).collect()]
    assert form("(c) you may keep it\n(C) 2020 nobody\nCopyright Jane Doe\ncopyright holders stay", "Лицензия 许可证", "programmed licences, the licence licence sub-\nlicense\nnon-commercial") == [
        "c you may keep it copyright holders stay", "лицензия 许可证", "programmed licences the license license sublicense noncommercial",
    ]
    a, b = form("(a) do\n(b) so\n(c) this", "(a) do\n(b) so\n(c) that")
    assert a != b


def test_licenses_as_in_sql(spark, tmp_path):
    """The SQL on documents that are or hold licenses, of which the given tables have few."""
    mit, files = dict(licenses.KNOWN)["MIT"], dict(reversed(licenses.common_licenses()))
    texts = [mit, "intro\n" + mit, files["MPL-2.0"] + "\nend", files["BSD-2-Clause"], "a\nReleased under the MIT License.\n" + files["Unlicense"], None, "", "prose of no license at all"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(licenses.OP4_SQL).df()
    got = licenses.op4_licenses(spark, str(tmp_path)).toPandas()
    key = lambda df: sorted(tuple(str(v) for v in r) for r in df[sorted(df.columns)].fillna("-").itertuples(index=False))
    assert sorted(got.columns) == sorted(want.columns) and key(got) == key(want) and (got["blocks"] != "").sum() == 5
