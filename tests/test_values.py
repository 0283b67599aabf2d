"""Contents as JSON values, and plans that parse each text once."""

import json

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from palimpsest.functions import values
from palimpsest.operators import conversation
from palimpsest.sources import sse


def plain(body):
    """The rule for contents, written plainly."""
    try:
        v = json.loads(body)
    except ValueError:
        return ""
    if v is None or v is False or v == 0 and not isinstance(v, (list, dict, str)):
        return ""
    if isinstance(v, str):
        return v.strip(values.BLANKS)
    if isinstance(v, list):
        texts = [b if isinstance(b, str) else b.get("text") or "" if isinstance(b, dict) else "" for b in v]
        return "\n".join(t for t in texts if t)
    return json.dumps(v, ensure_ascii=False, separators=(",", ":"), sort_keys=True)


WORDS = st.text("ab é\n\t\"\\[{", max_size=6)
BLOCKS = st.one_of(WORDS, st.none(), st.integers(-3, 3), st.booleans(), st.lists(WORDS, max_size=2), st.fixed_dictionaries({"type": WORDS}, optional={"text": WORDS}))
BODIES = st.one_of(BLOCKS, st.lists(BLOCKS, max_size=4)).map(lambda v: json.dumps(v, ensure_ascii=False)) | WORDS


@settings(max_examples=3, deadline=None)
@given(st.lists(BODIES, min_size=60, max_size=200))
def test_content_text_is_the_plain_rule(spark, bodies):
    rows = spark.createDataFrame(list(enumerate(bodies)), "n int, body string")
    got = values.parsed(rows, "body").select("n", values.content_text(F.col("json")).alias("t")).collect()
    assert {r["n"]: r["t"] for r in got} == {i: plain(b) for i, b in enumerate(bodies)}


def test_only_whole_texts_are_json(spark):
    texts = ['{"a": 1}', ' [1]\n', '{"a": 1} x', "[1] [2]", "1, 2", "1,3", "1] 2", "", " ", None, "nul", "null", '{"a": 1', '{"a": 1, "a": 2}']
    rows = spark.createDataFrame(list(enumerate(texts)), "n int, t string")
    good = {r["n"] for r in rows.where(values.is_json(F.col("t"))).collect()}
    assert good == {r["n"] for r in values.parsed(rows, "t").where("json IS NOT NULL").collect()} == {0, 1, 11}


def test_contents_of_a_text_column(spark):
    texts = ['[{"text":" a "},{"text":""},"b",{"x":1}]', " [1] as said ", '{"b": 1, "a": 2}', None, "", "42", "\n x\t"]
    rows = spark.createDataFrame(list(enumerate(texts)), "n int, content string").withColumn("json", F.lit("clash"))
    got = {r["n"]: r["content"] for r in values.with_content(rows, "content").collect()}
    assert got == {0: " a \nb", 1: "[1] as said", 2: '{"b": 1, "a": 2}', 3: None, 4: "", 5: "42", 6: "x"}


def test_a_text_is_parsed_once(spark):
    packets = spark.createDataFrame([("s", "claude", None, 0, "data: {}\n\n")], "stream_id string, platform string, conversation_id string, seq int, packet string")
    for made in (sse.reassemble(packets), sse.usage_of_frames(packets), values.with_content(packets, "packet")):
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        assert plan.lower().count("parsejson") + plan.lower().count("parse_json") == 1, plan


def test_user_messages_of_each_service(spark):
    last = lambda c, role="user": json.dumps({"messages": [{"role": "x", "content": "old"}, {"role": role, "content": c}]})
    cases = [
        ("claude", '{"prompt": "p"}', "p"), ("claude", last("t"), "t"), ("claude", last([{"text": "a"}, {"type": "image"}, {"text": "b"}]), "ab"), ("claude", last("t", "assistant"), None),
        ("claude", last([]), None), ("claude", "broken", None), ("chatgpt", last({"parts": ["a", "b"]}), "ab"), ("chatgpt", last("t"), "t"), ("chatgpt", last({"x": 1}), None),
        ("gemini", '{"query": "q", "prompt": "p"}', "q"), ("gemini", last("t"), "t"), ("gemini", "{}", None), ("gemini", None, None), ("chatgpt", '{"messages": []}', None),
    ]
    rows = values.parsed(spark.createDataFrame([(i, p, b) for i, (p, b, _) in enumerate(cases)], "n int, platform string, body string"), "body")
    got = {r["n"]: r["m"] for r in rows.select("n", sse.user_message(F.col("json"), F.col("platform")).alias("m")).collect()}
    assert got == {i: want for i, (_, _, want) in enumerate(cases)}


def test_batches_of_ids_of_any_type(spark):
    for kind, ids in (("string", [f"c{i * 7919 % 1000:04}" for i in range(500)] + [None]), ("long", [i * 10**14 for i in range(300)])):
        turns = spark.createDataFrame([(i, t) for i in ids for t in range(2)], f"conv_id {kind}, turn int")
        got = {r["conv_id"]: (r["batch"], r["n_turns"]) for r in conversation.migration_batches(turns, 25, per_range=40).collect()}
        assert got == {c: (i // 25 + 1, 2) for i, c in enumerate(sorted(ids, key=lambda c: (c is not None, c)))}
