"""Tables of the conversation model, derived from the plain tables by fixed rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EPOCH_MS = 1_704_067_200_000
PLATFORMS = ["claude", "chatgpt", "gemini", "perplexity"]
# The kinds and the confidences of facts.
CATEGORIES = ["preference", "personal", "work", "technical", "project", "decision", "goal", "skill", "general"]
CONFIDENCES = ["high", "medium", "low"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


TASK_ROWS = 50_000  # rows of a few bytes in a file that a task makes texts of and reads


def dealt(df: DataFrame, key: str) -> DataFrame:
    """``df`` in as many parts as its rows ask for: a file of many short rows is one task's or two's otherwise."""
    return df.repartition(1 + df.count() // TASK_ROWS, key)


def _pick(values: list[str], n):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(n, F.lit(len(values))) + 1).cast("int"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, conv_id, turn, platform, role, content, ts_ms."""
    return table(spark, sf_dir, "conversations").select(
        F.concat_ws("-", "conv_id", "turn").alias("id"),
        "conv_id",
        "turn",
        _pick(PLATFORMS, F.col("conv_id")).alias("platform"),
        "role",
        F.col("text").alias("content"),
        (F.lit(EPOCH_MS) + F.col("conv_id") * 3_600_000 + F.col("turn") * 60_000).cast("long").alias("ts_ms"),
    )


def turns_with_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``turns`` and, of each third turn, copies 1 and 6 seconds later, with the order of arrival."""
    t = turns(spark, sf_dir).withColumn("arrival", F.col("turn") * 10)
    third = t.where(F.col("turn") % 3 == 0)
    later = [
        third.withColumns({"id": F.concat("id", F.lit(name)), "ts_ms": F.col("ts_ms") + ms, "arrival": F.col("arrival") + at}) for name, ms, at in (("-a", 1_000, 1), ("-b", 6_000, 2))
    ]
    return t.unionByName(later[0]).unionByName(later[1])


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, content, category, confidence, ts_ms; a fact for each document."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"),
        F.col("text").alias("content"),
        _pick(CATEGORIES, F.col("doc_id")).alias("category"),
        _pick(CONFIDENCES, F.col("doc_id")).alias("confidence"),
        (F.lit(EPOCH_MS) + F.col("doc_id") * 600_000).cast("long").alias("ts_ms"),
    )


TOOLS = ["redis", "docker", "nginx", "postgres", "ollama"]
PLACES = ["vps1", "homelab", "ubuntu", "debian"]


def graph_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, content, ts_ms: sentences over suppliers and parts that name tools, places, versions and ports."""
    s = dealt(table(spark, sf_dir, "supplier").select("s_suppkey"), "s_suppkey").select(
        F.col("s_suppkey").alias("id"),
        F.concat(
            F.lit("BillingGateway uses "), _pick(TOOLS, F.col("s_suppkey")), F.lit(" and runs on "), _pick(PLACES, F.col("s_suppkey")), F.lit(" at port "), (F.lit(8000) + F.col("s_suppkey") % 7).cast("string")
        ).alias("content"),
    )
    p = dealt(table(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_partkey").select(
        (F.col("p_partkey") + 1_000_000).alias("id"),
        F.concat(
            F.lit("svc-part-"), _pick(["alpha", "beta", "gamma"], F.col("p_partkey")), F.lit(" depends on "), _pick(TOOLS, F.col("p_partkey")), F.lit(" v1."), (F.col("p_size") % 3).cast("string"),
            F.lit(".0 and is part of the "), _pick(PLACES, F.col("p_partkey")), F.lit(" cluster"),
        ).alias("content"),
    )
    return s.unionByName(p).withColumn("ts_ms", F.lit(EPOCH_MS) + F.col("id") * 1000)


def stream_packets(spark: SparkSession, sf_dir: str, width: int = 40) -> DataFrame:
    """stream_id, platform, conversation_id, seq, packet: each assistant turn as server-sent events of ``width`` characters."""
    t = turns(spark, sf_dir).where("role = 'assistant'")
    pieces = t.select("id", "conv_id", "platform", "content", F.explode(F.sequence(F.lit(0), F.ceil(F.length("content") / width).cast("int"))).alias("seq"))
    piece = F.substring(F.col("content"), F.col("seq") * width + 1, F.lit(width))
    text = F.to_json(F.struct(piece.alias("t")))
    text = F.substring(text, F.lit(6), F.length(text) - 6)  # the JSON string alone
    frame = (
        F.when(F.col("platform") == "claude", F.concat(F.lit('{"type":"content_block_delta","delta":{"type":"text_delta","text":'), text, F.lit("}}")))
        .when(F.col("platform") == "chatgpt", F.concat(F.lit('{"message":{"content":{"parts":['), text, F.lit("]}}}")))
        .when(F.col("platform") == "gemini", F.concat(F.lit('{"candidates":[{"content":{"parts":[{"text":'), text, F.lit("}]}}]}")))
        .otherwise(F.concat(F.lit('{"choices":[{"delta":{"content":'), text, F.lit("}}]}")))
    )
    last = F.col("seq") * width >= F.length("content")
    packet = F.when(last, F.lit("data: [DONE]\n\n")).otherwise(F.concat(F.lit("data: "), frame, F.lit("\n\n")))
    return pieces.select(F.col("id").alias("stream_id"), "platform", F.col("conv_id").cast("string").alias("conversation_id"), "seq", packet.alias("packet"))


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, conversation_id, input_tokens, output_tokens, ts_ms: a usage event for each row of events, by user."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"),
        "user_id",
        F.expr("CAST(event_id DIV 4 AS BIGINT) % 3").alias("conversation_id"),
        F.floor(F.abs(F.col("value")) * 10).cast("long").alias("input_tokens"),
        F.floor(F.abs(F.col("value")) * 3).cast("long").alias("output_tokens"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"),
    )
