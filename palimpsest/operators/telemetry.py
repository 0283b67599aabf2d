"""Token usage over time, cost, and the health of a conversation's memory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def islands(usage: DataFrame) -> DataFrame:
    """``usage`` (user_id, seq, conversation_id, input_tokens, output_tokens) with the island of each event, a new one at
    each change of conversation, and running totals within the island and over the user's session."""
    order = Window.partitionBy("user_id").orderBy("seq")
    change = F.when(F.col("conversation_id") == F.lag("conversation_id").over(order), 0).otherwise(1)
    rows = usage.withColumn("change", change).withColumn("island", F.sum("change").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    inside = Window.partitionBy("user_id", "island").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    session = order.rowsBetween(Window.unboundedPreceding, 0)
    return rows.select(
        "user_id", "seq", "island",
        F.sum("input_tokens").over(inside).alias("island_input"), F.sum("output_tokens").over(inside).alias("island_output"), F.sum("input_tokens").over(session).alias("session_input"),
    )


def latest_injection(events: DataFrame) -> DataFrame:
    """One row over injections (ts_ms, size, layers): how many, and the last one's values."""
    return events.agg(F.count("*").alias("n"), F.max("ts_ms").alias("last_ms"), F.max_by("size", "ts_ms").alias("last_size"), F.max_by("layers", "ts_ms").alias("last_layers"))


def memory_health(seconds_since: Column, chars: Column, n_facts: Column, depth: Column) -> Column:
    """0 to 100 from recency, volume, facts and depth."""
    recency = F.when(seconds_since < 30, 100).when(seconds_since < 120, 80).when(seconds_since < 300, 55).when(seconds_since < 900, 30).otherwise(10)
    volume = F.least(F.lit(100.0), F.floor(chars / 2000 * 100 + 0.5).cast("double"))
    of_facts = F.least(F.lit(100.0), (n_facts * 12).cast("double"))
    of_depth = F.least(F.lit(100.0), (depth * 20).cast("double"))
    return F.floor(recency * 0.35 + volume * 0.25 + of_facts * 0.25 + of_depth * 0.15 + 0.5).cast("long")


def health_label(score: Column) -> Column:
    return F.when(score >= 80, "excellent").when(score >= 55, "good").when(score >= 30, "fair").otherwise("poor")


def vector_stats(vectors: DataFrame) -> DataFrame:
    """model, n, kilobytes of 4-byte components, and when the oldest and the newest of ``vectors`` (model, vector, created_at) came."""
    kilobytes = F.floor(F.sum(F.size("vector")) * 4 / 1024 + 0.5).cast("long")
    return vectors.groupBy("model").agg(F.count("*").alias("n"), kilobytes.alias("kilobytes"), F.min("created_at").alias("oldest"), F.max("created_at").alias("newest"))
