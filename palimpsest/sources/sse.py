"""Server-sent event streams of chat services, reassembled into texts.

Packets of a stream, in ``seq`` order, are joined before they are cut into lines, so a frame may be
split anywhere.  Only lines that begin ``data: `` count; ``[DONE]`` ends a stream; frames that are
not JSON are passed over.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.values import block_texts, is_json, items_at, kind, number_at, parsed, text_at

def frame_text(platform: Column, json: Column) -> Column:
    """The text that a frame (VARIANT) brings; null if it brings none."""
    kind_of = F.try_variant_get(json, "$.type", "string")
    claude = F.when(
        (kind_of == "content_block_delta") & (F.try_variant_get(json, "$.delta.type", "string") == "text_delta"), F.try_variant_get(json, "$.delta.text", "string")
    ).when(kind_of == "completion", F.try_variant_get(json, "$.completion", "string"))
    content = F.when(kind(F.try_variant_get(json, "$.content", "variant")) == "STRING", text_at(json, "$.content"))
    return (
        F.when(platform == "claude", claude)
        .when(platform == "chatgpt", F.try_variant_get(F.try_element_at(items_at(json, "$.message.content.parts"), F.lit(-1)), "$", "string"))
        .when(platform == "gemini", text_at(json, "$.candidates[0].content.parts[0].text"))
        .when(platform == "perplexity", text_at(json, "$.choices[0].delta.content", "$.text"))
        .otherwise(F.coalesce(text_at(json, "$.choices[0].delta.content", "$.delta.text", "$.text"), content))
    )


def inner_conversation(json: Column) -> Column:
    """The conversation that a frame (VARIANT) names."""
    return text_at(json, "$.conversation_id", "$.message.conversation_id")


def frames(packets: DataFrame) -> DataFrame:
    """stream_id, platform, conversation_id, at, frame of each frame before the end of its stream."""
    whole = packets.groupBy("stream_id").agg(
        F.first("platform", ignorenulls=True).alias("platform"),
        F.max("conversation_id").alias("conversation_id"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "packet"))), lambda p: p["packet"]), "").alias("body"),
    )
    lines = F.transform(F.split("body", "\n"), lambda x: F.trim(x))
    data = F.transform(F.filter(lines, lambda x: x.startswith("data: ")), lambda x: F.trim(F.substring(x, F.lit(6), F.length(x))))
    cut = whole.withColumn("data", data).withColumn("done", F.array_position(F.transform("data", lambda x: F.lower(x) == "[done]"), True))
    cut = cut.withColumn("data", F.when(F.col("done") > 0, F.slice("data", F.lit(1), (F.col("done") - 1).cast("int"))).otherwise(F.col("data")))
    return cut.select("stream_id", "platform", "conversation_id", F.posexplode_outer("data").alias("at", "frame"))


def reassemble(packets: DataFrame, mode: str = "concat") -> DataFrame:
    """stream_id, platform, conversation_id, content, chunk_count.

    ``concat`` joins all pieces; ``latest`` takes the last one of streams whose frames are cumulative.
    """
    got = parsed(frames(packets), "frame").select("stream_id", "platform", "conversation_id", "at", frame_text(F.col("platform"), F.col("json")).alias("piece"), inner_conversation(F.col("json")).alias("inner"))
    pieces = F.transform(F.array_sort(F.collect_list(F.when(F.col("piece").isNotNull(), F.struct("at", "piece")))), lambda p: p["piece"])
    out = got.groupBy("stream_id").agg(
        F.first("platform").alias("platform"), F.coalesce(F.max("conversation_id"), F.max("inner")).alias("conversation_id"), pieces.alias("pieces")
    )
    joined = F.array_join("pieces", "")
    content = joined if mode == "concat" else F.when(F.col("platform") == "chatgpt", F.coalesce(F.try_element_at("pieces", F.lit(-1)), F.lit(""))).otherwise(joined)
    return out.select("stream_id", "platform", "conversation_id", content.alias("content"), F.size("pieces").cast("long").alias("chunk_count"))


def usage_of_frames(packets: DataFrame) -> DataFrame:
    """stream_id, input_tokens, output_tokens: of each the last that is not zero."""
    json = F.col("json")
    tokens_in = number_at(json, "$.message.usage.input_tokens", "$.usage.input_tokens", "$.usage.prompt_tokens")
    tokens_out = number_at(json, "$.usage.output_tokens", "$.message.usage.output_tokens", "$.usage.completion_tokens")
    got = parsed(frames(packets), "frame").select("stream_id", "at", tokens_in.alias("i"), tokens_out.alias("o"))
    last = lambda c, name: F.coalesce(F.max_by(c, F.when(F.col(c).isNotNull(), F.col("at"))), F.lit(0)).alias(name)
    return got.groupBy("stream_id").agg(last("i", "input_tokens"), last("o", "output_tokens"))


# Host and path of each service's endpoint; the first that fits counts.
ENDPOINTS = [
    ("claude", r"claude\.ai$", r"/api/organizations/[^/]+/chat_conversations/([^/]+)/completion", 1),
    ("chatgpt", r"(chat\.openai\.com|chatgpt\.com)$", r"/backend-api/conversation$", 0),
    ("gemini", r"gemini\.google\.com$", r"/(_/BardChatUi/|api/generate|StreamGenerate)", 0),
    ("perplexity", r"perplexity\.ai$", r"/api/query", 0),
]


def match_endpoints(urls: DataFrame) -> DataFrame:
    """``urls`` (url) with platform and conversation_id of the endpoint, both null if none fits."""
    host = F.try_parse_url("url", F.lit("HOST"))
    platform, conversation = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, hosts, path, group in reversed(ENDPOINTS):
        fits = host.rlike(hosts) & F.col("url").rlike(path)
        platform = F.when(fits, name).otherwise(platform)
        found = F.regexp_extract("url", path, group) if group else F.lit(None).cast("string")
        conversation = F.when(fits, found).otherwise(conversation)
    return urls.withColumns({"platform": platform, "conversation_id": conversation})


def user_message(json: Column, platform: Column) -> Column:
    """What the user wrote, from the body of a request (VARIANT): of the services that send a history its last message."""
    last = F.try_element_at(items_at(json, "$.messages"), F.lit(-1))
    content = text_at(last, "$.content")
    shape = kind(F.try_variant_get(last, "$.content", "variant"))
    blocks = F.nullif(F.array_join(block_texts(last, "$.content"), ""), F.lit(""))
    said = F.when(shape == "ARRAY", blocks).when(shape == "STRING", content)
    of_claude = F.coalesce(text_at(json, "$.prompt"), F.when(text_at(last, "$.role") == "user", said))
    parts = F.transform(items_at(last, "$.content.parts"), lambda p: F.try_variant_get(p, "$", "string"))
    of_chatgpt = F.when(parts.isNotNull(), F.array_join(parts, "")).when(shape == "STRING", content)
    return F.when(platform == "claude", of_claude).when(platform == "chatgpt", of_chatgpt).otherwise(F.coalesce(text_at(json, "$.query", "$.prompt"), content))


def response_body(body: Column, most: int = 50_000) -> Column:
    """A whole response's body, up to ``most`` characters, if it is JSON; else null."""
    return F.when(is_json(body), F.substring(body, 1, most))
