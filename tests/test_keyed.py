import os
import random

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import conversation, versions
from palimpsest.operators.keyed import KeyedTable
from palimpsest.streaming.rollups import TURNS, Conversations

SCHEMA = "id long, v long, x string"


def files(path):
    return {os.path.join(d, f) for d, _, names in os.walk(f"{path}/data") for f in names if f.endswith(".parquet")}


@pytest.fixture
def table(spark, tmp_path):
    t = KeyedTable.create(spark, str(tmp_path / "t"), SCHEMA, "id", 32)
    return t.put(spark.range(1000).select("id", F.lit(1).cast("long").alias("v"), F.lit("old").alias("x")), "v")


def test_few_keys_few_buckets(spark, table):
    """An upsert of ten keys writes ten buckets at most, and the others' files stay the very same."""
    before = files(table.path)
    t = table.put(spark.range(10).select("id", F.lit(2).cast("long").alias("v"), F.lit("new").alias("x")), "v")
    fresh = files(table.path) - before
    assert 1 <= len({f.split("__bucket=")[1].split("/")[0] for f in fresh}) <= 10 and before <= files(table.path)
    assert {r["id"] for r in t.read().where("x = 'new'").collect()} == set(range(10)) and t.read().count() == 1000
    assert len(t.lookup(3).inputFiles()) == 1 and t.lookup(3).first()["x"] == "new" and t.lookup(5000).count() == 0
    t.vacuum()
    assert KeyedTable(spark, t.path).read().count() == 1000 and len(files(t.path)) < len(before | fresh)


def test_rules(spark, table):
    old = spark.createDataFrame([(1, 0, "late"), (2, 1, "same"), (None, 1, "null"), (None, 5, "null too"), (2000, 1, "a"), (2000, 3, "b")], SCHEMA)
    t = table.put(old, "v")
    got = {r["id"]: r["x"] for r in t.read().collect()}
    assert (got[1], got[2], got[None], got[2000]) == ("old", "same", "null too", "b")
    t = t.add(spark.createDataFrame([(1, 9, "no"), (3000, 2, "z"), (3000, 1, "y"), (None, 9, "no")], SCHEMA), "v")
    got = {r["id"]: r["x"] for r in t.read().collect()}
    assert (got[1], got[3000], got[None], len(got)) == ("old", "y", "null too", 1003)
    t = t.delete(spark.createDataFrame([(None,), (5,), (77777,)], "id long"))
    assert {None, 5}.isdisjoint({r["id"] for r in t.read().collect()}) and t.read().count() == 1001
    assert t.put(spark.createDataFrame([], SCHEMA), "v").read().count() == 1001
    assert KeyedTable(spark, t.path).delete(t.read().select("id")).read().count() == 0


def test_a_writer_that_dies_and_one_that_is_late(spark, table, monkeypatch):
    other = KeyedTable(spark, table.path)
    rows = spark.createDataFrame([(1, 7, "x")], SCHEMA)

    def dies(*a):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(versions, "commit", dies)
        with pytest.raises(KeyboardInterrupt):
            table.put(rows, "v")
    assert KeyedTable(spark, table.path).read().where("x <> 'old'").count() == 0
    table.put(rows, "v")
    with pytest.raises(versions.Conflict):
        other.put(rows, "v")
    assert KeyedTable(spark, table.path).lookup(1).first()["v"] == 7


def made(n=60, seed=3):
    rnd = random.Random(seed)
    rows = [(f"{c}-{t}", c, "claude", t, "user" if t % 2 == c % 2 else "assistant", f"text {c} {t} " * rnd.randint(1, 20), 1000 * c + 10 * t) for c in range(n // 6) for t in range(6)]
    return rows, rnd


KIND = TURNS.removesuffix(", batch long")


def whole(spark, rows):
    return sorted(map(tuple, conversation.rollup(spark.createDataFrame(rows, KIND)).collect()))


def test_any_order_gives_the_batch_rollup(spark, tmp_path):
    rows, rnd = made()
    for seed in range(2):
        late = rows[:]
        rnd.shuffle(late)
        live = Conversations(spark, str(tmp_path / f"c{seed}"), 4)
        for n, at in enumerate(range(0, len(late), 25)):
            again = rnd.sample(late[: at + 25], 5)  # ids that came before count once
            live.arrive(spark.createDataFrame(late[at : at + 25] + again, KIND), n)
        got = live.rollup().select(*conversation.rollup(spark.createDataFrame(rows, KIND)).columns)
        assert sorted(map(tuple, got.collect())) == whole(spark, rows)
        assert live.turns().count() == len(rows)


def test_a_batch_that_runs_again(spark, tmp_path, monkeypatch):
    """A batch that died between its two tables, or after both, changes nothing when it is run again."""
    rows, _ = made(30)
    live = Conversations(spark, str(tmp_path / "c"), 4)
    first, second = spark.createDataFrame(rows[:20], KIND), spark.createDataFrame(rows[15:], KIND)
    live.arrive(first, 0)
    live.arrive(first, 0)
    change, calls = KeyedTable.change, []

    def dies(self, *a, **b):
        calls.append(self.path)
        if self.path.endswith("rollup"):
            raise KeyboardInterrupt
        return change(self, *a, **b)

    with monkeypatch.context() as m:
        m.setattr(KeyedTable, "change", dies)
        with pytest.raises(KeyboardInterrupt):
            live.arrive(second, 1)
    assert len(calls) == 2
    live = Conversations(spark, str(tmp_path / "c"))
    live.arrive(second, 1)
    got = live.rollup().select(*conversation.rollup(first).columns)
    assert sorted(map(tuple, got.collect())) == whole(spark, rows)


def test_a_stream_with_late_turns_and_a_restart(spark, tmp_path):
    rows, rnd = made(30)
    rnd.shuffle(rows)
    live = Conversations(spark, str(tmp_path / "c"), 4)
    for part in (rows[:12], rows[12:]):
        spark.createDataFrame(part, KIND).repartition(2).write.mode("append").json(str(tmp_path / "in"))
        stream = spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
        live.following(stream, str(tmp_path / "state")).awaitTermination(200)
    got = live.rollup().select(*conversation.rollup(spark.createDataFrame(rows, KIND)).columns)
    assert sorted(map(tuple, got.collect())) == whole(spark, rows)
