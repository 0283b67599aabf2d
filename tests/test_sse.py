import json

from hypothesis import given, settings
from hypothesis import strategies as st

from palimpsest.sources import sse

PACKETS = "stream_id string, platform string, conversation_id string, seq int, packet string"


def frame(o):
    return "data: " + json.dumps(o) + "\n\n"


def claude(t):
    return frame({"type": "content_block_delta", "index": 0, "delta": {"type": "text_delta", "text": t}})


def run(spark, platform, packets, conversation=None, mode="concat"):
    df = spark.createDataFrame([("s", platform, conversation, i, p) for i, p in enumerate(packets)], PACKETS)
    return sse.reassemble(df, mode).first()


def test_claude_stream(spark):
    r = run(spark, "claude", [frame({"type": "message_start"}), claude("Seven"), claude(" crates of pears"), claude(" came today."), "data: [DONE]\n\n", claude("late")], "conv-abc")
    assert (r["content"], r["platform"], r["conversation_id"], r["chunk_count"]) == ("Seven crates of pears came today.", "claude", "conv-abc", 3)


def test_frame_split_over_packets(spark):
    whole = claude("Hi")
    assert run(spark, "claude", [whole[:25], whole[25:]])["content"] == "Hi"


def test_chatgpt_cumulative_frames(spark):
    f = [frame({"message": {"content": {"parts": [t]}}, "conversation_id": "c-1"}) for t in ("Rain", "Rain by", "Rain by nine.")]
    r = run(spark, "chatgpt", f)
    assert r["content"] == "RainRain byRain by nine." and r["conversation_id"] == "c-1"
    assert run(spark, "chatgpt", f, mode="latest")["content"] == "Rain by nine."


def test_perplexity_gemini_and_others(spark):
    assert run(spark, "perplexity", [frame({"choices": [{"index": 0, "delta": {"content": t}}]}) for t in ("Turn left", " at the mill.")])["content"] == "Turn left at the mill."
    assert run(spark, "gemini", [frame({"candidates": [{"content": {"parts": [{"text": t}], "role": "model"}}]}) for t in ("Two eggs ", "and flour")])["content"] == "Two eggs and flour"
    assert run(spark, "other", [frame({"text": "a"}), frame({"delta": {"text": "b"}})])["content"] == "ab"


def test_edges(spark):
    assert run(spark, "claude", [""])["content"] == ""
    assert run(spark, "claude", ["data: {not json}\n\n", claude("ok")])["content"] == "ok"
    assert run(spark, "claude", ["data:" + json.dumps({"type": "completion", "completion": "x"}) + "\n\n"])["content"] == ""
    assert run(spark, "claude", [frame({"type": "completion", "completion": "x"})])["content"] == "x"


@settings(max_examples=8, deadline=None)
@given(st.lists(st.integers(1, 60), min_size=1, max_size=6))
def test_packet_bounds_do_not_matter(spark, cuts):
    body, packets, at = claude("One, ") + claude("twö") + claude("!") + "data: [DONE]\n", [], 0
    for c in cuts:
        packets.append(body[at : at + c])
        at += c
    assert run(spark, "claude", [*packets, body[at:]])["content"] == "One, twö!"


def test_endpoints(spark):
    urls = ["https://claude.ai/api/organizations/o/chat_conversations/c9/completion", "https://chatgpt.com/backend-api/conversation", "https://www.perplexity.ai/api/query?x", "https://evil.com/api/query", "not a url", None]
    got = [tuple(r)[1:] for r in sse.match_endpoints(spark.createDataFrame([(u,) for u in urls], "url string")).collect()]
    assert got == [("claude", "c9"), ("chatgpt", None), ("perplexity", None), (None, None), (None, None), (None, None)]


def test_usage(spark):
    f = [frame({"type": "message_start", "message": {"usage": {"input_tokens": 5, "output_tokens": 1}}}), frame({"usage": {"output_tokens": 9}}), frame({"usage": {"output_tokens": 0}})]
    df = spark.createDataFrame([("s", "claude", None, i, p) for i, p in enumerate(f)], PACKETS)
    assert tuple(sse.usage_of_frames(df).first()) == ("s", 5, 9)
