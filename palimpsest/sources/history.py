"""History exports: turns and artifacts of message lists, paged reading, and what still has to be fetched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions.values import items_at, kind, parsed, text_at

BLOCKS = "array<struct<type:string,text:string,content:string>>"


def artifact_fields(block: Column) -> dict[str, Column]:
    """Fields of a block's text that opens an artifact."""
    find = lambda p: F.nullif(F.regexp_extract(block, p, 1), F.lit(""))
    body = r"(?s)<antArtifact[^>]*>(.*?)</antArtifact>"
    return {
        "artifact_id": find('identifier="([^"]+)"'),
        "title": F.coalesce(find('title="([^"]+)"'), F.lit("untitled")),
        "language": F.coalesce(find('language="([^"]+)"'), F.lit("text")),
        "body": F.coalesce(F.nullif(F.trim(F.regexp_extract(block, body, 1)), F.lit("")), block),
    }


def artifacts(messages: DataFrame) -> DataFrame:
    """Artifacts of ``messages`` (message_id, role, content: JSON list of blocks)."""
    blocks = messages.select("message_id", "role", F.posexplode(F.from_json("content", BLOCKS)).alias("at", "b"))
    text = F.coalesce(F.nullif("b.text", F.lit("")), F.col("b.content"), F.lit(""))
    wanted = blocks.withColumn("block", text).where(F.col("block").contains("<antArtifact") | (F.col("b.type") == "tool_result"))
    return wanted.select("message_id", "role", "at", *[c.alias(n) for n, c in artifact_fields(F.col("block")).items()])


def history_turns(messages: DataFrame) -> DataFrame:
    """Turns of ``messages`` (conv_id, uuid, sender, content, text, created_at); content is text or a JSON list of blocks."""
    blocks = F.filter(items_at(F.col("__json")), lambda b: F.try_variant_get(b, "$.type", "string") == "text")
    joined = F.array_join(F.transform(blocks, lambda b: F.coalesce(text_at(b, "$.text"), F.lit(""))), "\n")
    text = F.when(kind(F.col("__json")) == "ARRAY", joined).otherwise(F.coalesce("content", "text"))
    role = F.when(F.col("sender") == "human", "user").otherwise(F.coalesce("sender", F.lit("unknown")))
    out = parsed(messages, "content", "__json").select(
        F.col("uuid").alias("id"), F.lit("claude.ai").alias("platform"), "conv_id", role.alias("role"), text.alias("content"), F.lit("backfill").alias("capture_type"),
        F.unix_millis(F.to_timestamp("created_at")).alias("ts_ms"),
    )
    return out.where(F.trim(F.coalesce("content", F.lit(""))) != "")


def still_to_fetch(listing: DataFrame, done: DataFrame) -> DataFrame:
    """Rows of ``listing`` (conv_id, message_count) not in ``done`` (conv_id, turns) or with more messages than turns there."""
    return listing.join(done, "conv_id", "left").where(F.col("turns").isNull() | (F.col("message_count") > F.col("turns"))).select(*listing.columns)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """page, body of the files page-N.json of a folder, on any file system that Spark reads."""
    files = spark.read.option("wholetext", True).text(f"{path}/page-*.json")
    number = F.regexp_extract(F.col("_metadata.file_path"), r"page-(\d+)\.json$", 1)
    return files.select(number.cast("int").alias("page"), F.col("value").alias("body"))


def page_items(pages: DataFrame, page_size: int = 50) -> DataFrame:
    """page, at, item, error of ``pages`` (page, body: a JSON list of objects), up to the first that has fewer than ``page_size`` items.

    A page that is no JSON list gives one row with its error, and the reading goes on.  Pages are
    parsed where they are read; what decides the end is one number.
    """
    items = F.from_json("body", "array<string>")
    counted = pages.select("page", "body", F.json_array_length("body").alias("n"))
    end = counted.where(F.col("n") < page_size).agg(F.min("page").alias("end"))
    wanted = counted.join(F.broadcast(end), F.coalesce(F.col("page") <= F.col("end"), F.lit(True)))  # one row
    good = wanted.where("n IS NOT NULL").select("page", F.posexplode(items).alias("at", "item"), F.lit(None).cast("string").alias("error"))
    bad = wanted.where("n IS NULL").select("page", F.lit(0).alias("at"), F.lit(None).cast("string").alias("item"), F.lit("no JSON list").alias("error"))
    return good.unionByName(bad)
