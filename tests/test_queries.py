"""Every query of the catalogue against its DuckDB SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

from palimpsest.plans.catalog import QUERIES
from palimpsest.plans.oracle import ORACLE_SQL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def value(v):
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, float):
        return "null" if v != v else f"{v:.7g}"
    if v is None or str(v) in ("NaT", "<NA>"):
        return "null"
    return f"{v:.7g}" if isinstance(v, int) and not isinstance(v, bool) and abs(v) < 1e6 else str(v)


def rows(df):
    df = df[sorted(df.columns)]
    return list(df.columns), sorted(tuple(value(v) for v in r) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    assert len(got.columns)
    if name in ORACLE_SQL:
        assert rows(got) == rows(duck.execute(ORACLE_SQL[name]).df())


def test_entry_imports(spark):
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["id", "score"]
