"""The engine: batches, sending, facts, exports and jobs."""

from pyspark.sql import functions as F

from palimpsest.engine import Engine, Job, usual_jobs
from palimpsest.operators import conversation
from palimpsest.sources import views

SF = "/root/testdata/sf0.001"
TURNS = "id string, conv_id long, platform string, turn long, role string, content string, ts_ms long"
MINUTE = 60_000


def turn(c, n, content="redis server on the box", ms=None):
    return (f"{c}-{n}", c, "claude", n, "user" if n % 2 == 0 else "assistant", content, n * 1000 if ms is None else ms)


def table(spark, *rows):
    return spark.createDataFrame(list(rows), TURNS)


def ids(df, column="conv_id"):
    return sorted(r[column] for r in df.collect())


def answered(texts):
    return texts.withColumn("answer", F.concat(F.lit('[{"content": "talk '), "conv_id", F.lit(' is about redis", "confidence": "high"}]')))


def test_capture_send_search_and_export(spark, tmp_path):
    e, sent = Engine(spark, f"file://{tmp_path}/a", 4), []
    first = table(spark, turn(1, 0), turn(1, 1), turn(2, 0, "docker swarm"), turn(3, 0, "nothing at all"))
    e.capture(first, 0)
    e.capture(first, 0)  # the batch again
    assert e.turns().count() == 4 and ids(e.search("docker?"), "id") == ["2-0"] and ids(e.retrieve("redis please"), "id") == ["1-0", "1-1"]

    def broken(rows):
        raise OSError("no way\nout")

    assert not e.flush(broken, 5_000) and ids(e.unsynced()) == [1, 2, 3]
    assert e.flush(lambda rows: sent.extend(ids(rows, "id")), 6_000) and sent == ["1-0", "1-1", "2-0", "3-0"] and ids(e.unsynced()) == []
    e.capture(table(spark, turn(1, 2, ms=10), turn(2, 1, ms=9_000)), 1)  # one of them late
    assert ids(e.unsynced()) == [1, 2]
    assert [(r["timestamp"], r["status"], r["turns_flushed"], r["error"]) for r in e.log().collect()] == [(6_000, "ok", 4, None), (5_000, "error", 0, "no way")]
    assert e.stats().first()["n_turns"] == 6

    e.save_settings(spark.createDataFrame([("mode", "x")], "key string, value string"))
    e.learn(answered, 7_000, least_turns=1, most=2)
    e.export(f"file://{tmp_path}/export", "2024-01-01T00:00:00Z")
    again = Engine(spark, f"file://{tmp_path}/b", 4)
    again.import_(f"file://{tmp_path}/export", 0)
    assert sorted(again.turns().collect()) == sorted(e.turns().collect()) and sorted(again.facts().collect()) == sorted(e.facts().collect())
    assert again.setting("mode", "y").first()["value"] == "x" and again.setting("none", "y").first()["value"] == "y" and again.log().count() == 2
    assert ids(again.search("docker"), "id") == ids(e.search("docker"), "id")


def test_facts_are_taken_from_changed_conversations(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/m", 4)
    long = "words " * 30
    e.capture(table(spark, *[turn(c, n, long) for c in (1, 2, 3) for n in range(2)]), 0)
    e.learn(answered, 10, least_turns=2, most=2)
    assert ids(e.facts()) == [1, 2]
    e.learn(answered, 20, least_turns=2, most=2)
    assert ids(e.facts()) == [1, 2, 3] and e.graph_stats().count() == 1
    e.capture(table(spark, turn(1, 5, long)), 1)
    e.learn(answered, 30, least_turns=2, most=2)
    assert {r["conv_id"]: r["ts_ms"] for r in e.facts().collect()} == {1: 10, 2: 10, 3: 20}  # the same fact once


def test_jobs_run_when_due(spark, tmp_path):
    ran = []

    def fails(engine, now):
        ran.append(("fails", now))
        raise RuntimeError("not now")

    jobs = (Job("fails", 2 * MINUTE, fails), Job("often", MINUTE, lambda e, now: ran.append(("often", now))), Job("rare", 60 * MINUTE, lambda e, now: ran.append(("rare", now))))
    e = Engine(spark, f"file://{tmp_path}/m", 2, jobs)
    assert e.run_due(0) == ["fails", "often", "rare"] and e.run_due(MINUTE - 1) == []
    again = Engine(spark, f"file://{tmp_path}/m", 2, jobs)  # after a restart
    assert again.run_due(MINUTE) == ["often"] and again.run_due(30 * MINUTE) == ["fails", "often"] and again.run_due(30 * MINUTE + 1) == []
    assert ran == [("fails", 0), ("often", 0), ("rare", 0), ("often", MINUTE), ("fails", 30 * MINUTE), ("often", 30 * MINUTE)]
    assert {r["name"]: r["error"] for r in again.job_log().collect()} == {"fails": "not now", "often": None, "rare": None}


def test_a_stream_of_turns_drives_the_jobs(spark, tmp_path):
    sent, published = [], []
    path, jobs = f"file://{tmp_path}/m", usual_jobs(lambda rows: sent.append(ids(rows, "id")), answered, lambda rows: published.append(rows.count()))
    e = Engine(spark, path, 2, jobs)
    for n, rows in enumerate(([turn(1, 0, ms=0)], [turn(1, 1, ms=MINUTE)], [turn(2, 0, ms=3 * MINUTE)])):
        table(spark, *rows).coalesce(1).write.parquet(f"file://{tmp_path}/in/{n}")
        stream = spark.readStream.schema(TURNS).parquet(f"file://{tmp_path}/in/*")
        e.following(stream, f"{tmp_path}/cp").awaitTermination()
    assert sent == [["1-0"], ["1-0", "1-1", "2-0"]] and len(published) == 1 and e.turns().count() == 3


def test_roll_ups_are_those_of_the_turns(spark, tmp_path):
    e, t = Engine(spark, f"file://{tmp_path}/m", 4), views.turns(spark, SF)
    e.capture(t.where("turn % 2 = 1"), 0)
    e.capture(t, 1)
    assert sorted(e.conversations().collect()) == sorted(conversation.rollup(t).select(*e.conversations().columns).collect())
