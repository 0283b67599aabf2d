import hashlib
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import fill_in_middle as fim

PATTERNS = {"lines": r"[^\n]*\n|[^\n]+", "words": r"[^ \t-\r]*[ \t-\r]|[^ \t-\r]+", "sentences": r"[^.!?\n]*[.!?\n]|[^.!?\n]+", "characters": r"(?s:.)"}
MORE = ["\n", "\n\n\n", "no end", "a\nb", "a\nb\n", "😀 two\n𝒳é\n<", "x<P>y\nz", "<S>", "tail<M", "<M>", "a.b!c? d\v e", "\r\nb\r\n" * 50, "<\n<P\n<<\n"]


def plain(doc_id, text, unit, percent=100, suffix_first=50, seed=7):
    text = text or ""
    units = re.findall(PATTERNS[unit], text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = len(units)
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= percent:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < suffix_first else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


@pytest.fixture(scope="module")
def table(spark, rows, tmp_path_factory):
    every = rows + list(enumerate(MORE, 1000)) + [(None, "a\nb\nc"), (1000, "\n")]
    df = spark.createDataFrame([(d, t, 1, "x", "y", 2) for d, t in every], "doc_id long, text string, n int, form string, `a``b c` string, ends int").repartition(3)
    path = str(tmp_path_factory.mktemp("fim") / "documents")
    df.write.parquet(path)
    return every, spark.read.parquet(path), path


@pytest.mark.parametrize("unit", sorted(PATTERNS))
def test_rows(table, unit):
    every, df, _ = table
    out = fim.fill_in_middle(df, unit, percent=80)
    assert out.columns == ["doc_id", "text", "a`b c", "ends", *fim.ADDED]
    got = out.withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    want = [(d, t, *plain(d, t, unit, 80), t or "") for d, t in every]
    key = lambda r: tuple(map(str, r))
    assert sorted(((r["doc_id"], r["text"], *[r[c] for c in fim.ADDED], r["back"]) for r in got), key=key) == sorted(want, key=key)


def test_query_and_sql(spark, table, tmp_path):
    every, _, path = table
    import os

    os.symlink(path, tmp_path / "documents.parquet")
    got = sorted(map(str, (tuple(r) for r in fim.op13_fill_in_middle(spark, str(tmp_path)).collect())))
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = [plain(d, t, "lines") for d, t in every]
    assert got == sorted(str((d, *w[:4], digest(w[4]), digest(t or ""))) for (d, t), w in zip(every, want))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/*.parquet'")
    assert sorted(map(str, con.execute(fim.OP13_SQL).fetchall())) == got


def test_empty_and_long(spark, none):
    assert fim.fill_in_middle(none).count() == 0
    long = spark.createDataFrame([(1, "é line\n" * 500_000 + "end")], "doc_id long, text string")
    r = fim.fill_in_middle(long).withColumn("back", fim.restored(F.col("output"), F.col("form"))).first()
    assert r["n"] == 500_001 and r["back"] == r["text"] and r["form"] != "plain"


def test_sentinels(spark):
    with pytest.raises(ValueError):
        fim.fill_in_middle(spark.createDataFrame([], "doc_id long, text string"), sentinels=("<P>", "<P>x", "<M>"))
    marks = ("[pre]", "[suf]", "[mid]")
    df = spark.createDataFrame([(i, f"a{i}\nb\nc\nd[su\n") for i in range(20)] + [(99, "has [mid] in it")], "doc_id long, text string")
    got = fim.fill_in_middle(df, "lines", marks, seed=1, suffix_first=30).withColumn("back", fim.restored(F.col("output"), F.col("form"), marks)).collect()
    assert all(r["back"] == r["text"] for r in got) and {r["form"] for r in got} == {"psm", "spm", "plain"}
