from pyspark.sql import functions as F

from palimpsest.operators import conversation
from palimpsest.streaming import turns as live

ROWS = [(f"t{i}", i % 3, "user", "same" if i % 2 else f"text {i}", 1_700_000_000_000 + (i // 3) * 2_000) for i in range(30)]


def source(spark, tmp_path):
    spark.createDataFrame(ROWS + ROWS[:5], live.TURN).coalesce(1).write.json(str(tmp_path / "in"))
    return live.read_turns(spark, str(tmp_path / "in"))


def drain(df, mode, tmp_path, name):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def test_ids_once(spark, tmp_path):
    got = drain(live.distinct_turns(source(spark, tmp_path)), "append", tmp_path, "ids_once")
    assert sorted(r["id"] for r in got.collect()) == sorted(r[0] for r in ROWS)


def test_echoes_as_in_a_batch(spark, tmp_path):
    got = drain(live.without_echoes(live.distinct_turns(source(spark, tmp_path))), "append", tmp_path, "echoes")
    batch = spark.createDataFrame(ROWS, live.TURN).withColumn("arrival", F.col("ts_ms"))
    assert {r["id"] for r in got.collect()} == {r["id"] for r in conversation.without_echoes(batch).collect()}


def test_flush_once(spark, tmp_path):
    write = live.flush_once(str(tmp_path / "out"))
    batch = spark.createDataFrame(ROWS, live.TURN)
    write(batch, 0)
    write(batch, 0)
    assert spark.read.json(str(tmp_path / "out")).count() == len(ROWS)


def test_session_counts(spark, tmp_path):
    got = drain(live.turn_counts(source(spark, tmp_path), "1 second", "0 seconds"), "complete", tmp_path, "counts")
    assert sum(r["n"] for r in got.collect()) == len(ROWS) + 5


def test_restart_and_late_turns(spark, tmp_path):
    """A query that is started again goes on from its checkpoint and still knows what it accepted; late turns are put in order."""
    folder, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    parts = [[("a", 1, "user", "x", 10_000), ("b", 1, "user", "y", 12_000)], [("c", 1, "user", "x", 13_000), ("e", 1, "user", "z", 30_000), ("d", 1, "user", "z", 29_000)], [("f", 1, "user", "z", 40_000)]]
    for n, rows in enumerate(parts):
        spark.createDataFrame(rows, live.TURN).coalesce(1).write.mode("append").json(str(folder))
        stream = live.without_echoes(live.read_turns(spark, str(folder)).withWatermark("ts", "10 minutes"), ttl_ms=20_000)
        live.flushing(stream, out, state).awaitTermination(120)
        assert sorted(r["id"] for r in spark.read.json(out).collect()) == [["a", "b"], ["a", "b", "d"], ["a", "b", "d", "f"]][n]


def test_vectors_of_new_turns(spark, tmp_path):
    embed = lambda c: F.array(F.length(c).cast("double"))
    q = live.embedding(live.distinct_turns(source(spark, tmp_path)), embed, str(tmp_path / "v"), str(tmp_path / "s"))
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "v")).count() == len(ROWS)
