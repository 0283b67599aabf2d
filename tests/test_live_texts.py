import json
import random

import pytest
from pyspark.sql import functions as F

from palimpsest.sources import sse, views
from palimpsest.streaming.live_texts import LiveTexts

PACKET = "stream_id string, platform string, conversation_id string, seq long, packet string"


def frame(platform, text, whole):
    return {
        "claude": {"type": "content_block_delta", "delta": {"type": "text_delta", "text": text}},
        "chatgpt": {"message": {"content": {"parts": [whole + text]}}, "conversation_id": "inner"},
        "gemini": {"candidates": [{"content": {"parts": [{"text": text}]}}]},
        "perplexity": {"choices": [{"delta": {"content": text}}]},
    }[platform]


def streams(rnd, n=12):
    """Packets of streams whose bodies are cut anywhere: inside frames, lines and end marks."""
    out = []
    for i in range(n):
        platform = ["claude", "chatgpt", "gemini", "perplexity"][i % 4]
        body, whole = ": comment\n\nevent: x\n", ""
        for w in [f"w{rnd.randint(0, 9)} é{i} " for _ in range(rnd.randint(0, 12))]:
            body += f"data: {json.dumps(frame(platform, w, whole), ensure_ascii=i % 2 == 0)}\n" + rnd.choice(["", "\n", "data: {broken\n", "data:{}\n"])
            whole += w
        body += "data: [DONE]\ndata: " + json.dumps(frame(platform, "after the end", whole)) + "\n"
        at = sorted(rnd.sample(range(len(body)), min(len(body) - 1, rnd.randint(1, 30))))
        pieces = [body[a:b] for a, b in zip([0, *at], [*at, len(body)])]
        out += [(f"s{i}", platform if k == 0 else None, "c1" if i % 3 == 0 and k == 2 else None, k, p) for k, p in enumerate(pieces)]
    return out


def arrive(spark, live, tmp_path, packets, second=0, idle_ms=600_000):
    spark.createDataFrame(packets, PACKET).withColumn("ts_ms", F.lit(1_700_000_000_000 + second * 1000)).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    stream = spark.readStream.schema(PACKET + ", ts_ms long").json(str(tmp_path / "in")).withColumn("ts", F.timestamp_millis("ts_ms"))
    assert live.following(stream, str(tmp_path / "state"), idle_ms, "0 seconds").awaitTermination(100)


@pytest.mark.parametrize("shuffled", [False, True])
def test_any_cuts_as_in_a_batch(spark, tmp_path, shuffled):
    """Packets over three micro-batches, in order or not, with some of them twice, give what a batch gives."""
    rnd = random.Random(8 + shuffled)
    packets = streams(rnd)
    order = packets[:]
    if shuffled:
        rnd.shuffle(order)
    else:
        order.sort(key=lambda p: p[3])
    live = LiveTexts(spark, str(tmp_path / "t"), 4)
    third = len(order) // 3
    for n in range(3):
        arrive(spark, live, tmp_path, order[n * third : (n + 1) * third if n < 2 else None] + rnd.sample(order[: n * third], 3 if n else 0), n)
    for mode in ("concat", "latest"):
        want = sse.reassemble(spark.createDataFrame(packets, PACKET), mode)
        assert sorted(map(tuple, live.texts(mode).drop("ended").collect())) == sorted(map(tuple, want.collect()))
    assert {r["ended"] for r in live.texts().collect()} == {True}


def test_a_stream_that_stops(spark, tmp_path):
    """What waits is taken once nothing came for a while: the line without an end, and packets behind a gap."""
    say = lambda text: "data: " + json.dumps(frame("claude", text, ""))
    live = LiveTexts(spark, str(tmp_path / "t"), 2)
    arrive(spark, live, tmp_path, [("a", "claude", None, 0, say("one") + "\n" + say(" two")), ("b", "claude", "c", 0, say("x")), ("b", "claude", "c", 2, "\n" + say("z") + "\n")], 0, 1000)
    assert {r["stream_id"]: (r["content"], r["ended"]) for r in live.texts().collect()} == {"a": ("one", False), "b": ("", False)}
    arrive(spark, live, tmp_path, [("other", "claude", None, 0, say("y") + "\n")], 60, 1000)
    got = {r["stream_id"]: (r["content"], r["chunk_count"], r["ended"]) for r in live.texts().collect()}
    assert got["a"] == ("one two", 2, True) and got["b"] == ("xz", 2, True)


def test_a_batch_that_runs_again(spark, tmp_path):
    from palimpsest.streaming.live_texts import FRAMES

    live = LiveTexts(spark, str(tmp_path / "t"), 2)
    rows = spark.createDataFrame([("a", "perplexity", None, 0, json.dumps(frame("perplexity", "hi", "")), False)], FRAMES)
    for n in (0, 0, 1):
        live.arrive(rows, n)
    assert live.texts().first()["content"] == "hihi"


def test_turns_as_a_stream(spark, tmp_path):
    packets = views.stream_packets(spark, "/root/testdata/sf0.001")
    packets.repartition(2).write.json(str(tmp_path / "in"))
    live = LiveTexts(spark, str(tmp_path / "t"), 4)
    stream = spark.readStream.schema(packets.schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in")).withColumn("ts", F.timestamp_millis(F.col("seq") + 1_700_000_000_000))
    assert live.following(stream, str(tmp_path / "state")).awaitTermination(100)
    want = {r["stream_id"]: r["content"] for r in sse.reassemble(packets).collect()}
    assert {r["stream_id"]: r["content"] for r in live.texts().collect()} == want
