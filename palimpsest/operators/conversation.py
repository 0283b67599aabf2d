"""Turns into conversations: duplicates, roll-ups, change tracking, flushing and extraction input."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.text import token_estimate, truncated
from palimpsest.plans.steps import materialised


def key(platform: Column, conversation: Column, otherwise: Column) -> Column:
    """``platform:conversation``; a turn without one goes by an id of its own, never by the clock."""
    return F.concat_ws(":", platform, F.coalesce(conversation, F.concat(F.lit("unknown-"), otherwise)))


def last_turns(turns: DataFrame, n: int) -> DataFrame:
    """The last n turns of each conversation."""
    back = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    return turns.withColumn("_back", back).where(F.col("_back") <= n).drop("_back")


def first_by_id(turns: DataFrame) -> DataFrame:
    """Of rows with one id the first to arrive."""
    at = F.row_number().over(Window.partitionBy("id").orderBy("arrival"))
    return turns.withColumn("_at", at).where("_at = 1").drop("_at")


def without_echoes(turns: DataFrame, window_ms: int = 5_000, back: int = 5) -> DataFrame:
    """Turns (conv_id, arrival, role, content, ts_ms, ...) in order of arrival, without those that repeat an accepted one.

    A turn repeats if one of the last ``back`` accepted turns, by time, has its role and content
    and is less than ``window_ms`` away.  Conversations are sorted, not collected: a task streams
    through them in Arrow batches and carries the last ``back`` accepted turns alone.
    """
    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "arrival")

    def run(batches):
        import pyarrow as pa

        now, last = object(), []
        for b in batches:
            keep = []
            for conv, at, role, content, ms in zip(*[b.column(c).to_pylist() for c in ("conv_id", "arrival", "role", "content", "ts_ms")]):
                if conv != now:
                    now, last = conv, []
                again = role is not None and content is not None and any(r == role and c == content and abs(t - ms) < window_ms for t, _, r, c in last)
                keep.append(not again)
                if not again:
                    last = sorted([*last, (ms, at, role, content)], key=lambda x: x[:2])[-back:]
            yield b.filter(pa.array(keep, pa.bool_()))

    return ordered.mapInArrow(run, turns.schema)


def rollup(turns: DataFrame) -> DataFrame:
    """A row for each conversation of ``turns`` (conv_id, platform, turn, role, content, ts_ms)."""
    at = F.struct("turn", "ts_ms")
    title = F.min_by("content", F.when(F.col("role") == "user", at))
    return turns.groupBy("conv_id").agg(
        F.min_by("platform", at).alias("platform"),
        F.coalesce(truncated(title, 120), F.lit("(untitled)")).alias("title"),
        F.min_by("ts_ms", at).alias("started_at"),
        F.max("ts_ms").alias("updated_at"),
        F.count("*").alias("turn_count"),
        token_estimate(F.sum(F.length("content"))).alias("token_estimate"),
    )


def stats(conversations: DataFrame, synced: DataFrame) -> DataFrame:
    """One row over ``rollup`` rows and what was synced (conv_id, synced_at)."""
    rows = conversations.join(synced, "conv_id", "left")
    return rows.agg(
        F.count("*").alias("n_conversations"),
        F.sum("turn_count").alias("n_turns"),
        F.sum("token_estimate").alias("n_tokens"),
        F.count_if(F.col("synced_at").isNull() | (F.col("updated_at") > F.col("synced_at"))).alias("n_unsynced"),
        F.min("started_at").alias("oldest"),
        F.max("updated_at").alias("newest"),
    )


def by_platform(turns: DataFrame) -> DataFrame:
    return turns.groupBy("platform").agg(F.countDistinct("conv_id").alias("n_conversations"), F.count("*").alias("n_turns"), F.sum(F.length("content")).alias("n_chars"))


def conversations(rows: DataFrame, limit: int = 50, since_ms: int | None = None, platform: str | None = None, mode: str = "recent") -> DataFrame:
    """``recent``: the newest; ``cursor``: the first in key order (the oldest, with ``since_ms``), then by time."""
    if platform is not None:
        rows = rows.where(F.col("platform") == platform)
    if since_ms is not None:
        rows = rows.where(F.col("updated_at") >= since_ms)
    if mode == "cursor":
        rows = rows.orderBy("updated_at", "conv_id").limit(limit) if since_ms is not None else rows.orderBy("conv_id").limit(limit)
    return rows.orderBy(F.desc("updated_at"), "conv_id").limit(limit)


def changed_since(rows: DataFrame, ms: int) -> DataFrame:
    return rows.where(F.col("updated_at") > ms)


def popup_rows(rows: DataFrame, synced: DataFrame) -> DataFrame:
    is_synced = F.coalesce(F.col("synced_at") >= F.col("updated_at"), F.lit(False))
    return rows.join(synced, "conv_id", "left").select("conv_id", "platform", F.coalesce(F.nullif("title", F.lit("")), F.lit("(untitled)")).alias("title"), "turn_count", "updated_at", is_synced.alias("synced"))


def unsynced(conversations: DataFrame, synced: DataFrame) -> DataFrame:
    rows = conversations.join(synced, "conv_id", "left")
    return rows.where(F.col("synced_at").isNull() | (F.col("updated_at") > F.col("synced_at"))).select(*conversations.columns)


def flush_rows(turns: DataFrame, conversations: DataFrame, synced: DataFrame) -> DataFrame:
    """The turns of unsynced conversations as they are sent, ids kept."""
    return turns.join(unsynced(conversations, synced).select("conv_id"), "conv_id", "left_semi").select("conv_id", "id", "platform", "role", "content", "ts_ms")


def migration_batches(turns: DataFrame, size: int = 25, per_range: int = 500_000) -> DataFrame:
    """batch, conv_id, n_turns: conversations in order of their ids, of any type (null first), ``size`` to a batch.

    Conversations are dealt to ranges of some ``per_range`` and stored, so that each range is numbered
    by a task of its own; the one window without a partition adds up a number for each range.
    """
    per = materialised(turns.groupBy("conv_id").agg(F.count("*").alias("n_turns")))
    ranges = max(1, -(-per.count() // per_range))
    ranged = materialised(per.repartitionByRange(ranges, F.asc_nulls_first("conv_id")).withColumn("block", F.spark_partition_id()))
    counts = ranged.groupBy("block").agg(F.count("*").alias("n"))
    before = counts.select("block", (F.sum("n").over(Window.orderBy("block")) - F.col("n")).alias("before"))
    at = F.row_number().over(Window.partitionBy("block").orderBy(F.asc_nulls_first("conv_id"))) + F.col("before")
    return ranged.join(before, "block").select(F.ceil(at / size).cast("long").alias("batch"), "conv_id", "n_turns")


def extraction_text(turns: DataFrame, last: int = 20, each: int = 2_000, most: int = 8_000, least: int = 100) -> DataFrame:
    """conv_id, text: the last turns of each conversation with their speakers; conversations under ``least`` characters are left out."""
    speaker = F.when(F.col("role") == "user", "User: ").otherwise("Assistant: ")
    line = F.concat(speaker, F.substring("content", 1, each))
    tail = last_turns(turns.select("conv_id", "turn", "role", "content"), last).select("conv_id", F.struct("turn", line.alias("line")).alias("x"))
    per = tail.groupBy("conv_id").agg(F.array_sort(F.collect_list("x")).alias("lines"))
    text = F.substring(F.array_join(F.transform("lines", lambda x: x["line"]), "\n\n"), 1, most)
    return per.select("conv_id", text.alias("text")).where(F.length("text") >= least)


def to_extract(conversations: DataFrame, extracted: DataFrame, least_turns: int = 2, most: int = 10) -> DataFrame:
    """Conversations with turns enough that changed since facts were last taken from them, in key order."""
    rows = conversations.join(extracted, "conv_id", "left")
    due = F.col("extracted_at").isNull() | (F.col("updated_at") > F.col("extracted_at"))
    return rows.where(due & (F.col("turn_count") >= least_turns)).orderBy("conv_id").limit(most).select(*conversations.columns)


def new_words_query(turns: DataFrame, least: int = 15) -> DataFrame:
    """id, query: what each user message adds to the one before it in its conversation.

    Five or more words of over three characters that the one before lacks: the last 50 of them;
    else the last 500 characters.  Messages under ``least`` characters count for nothing.
    """
    clean = turns.where(F.col("role") == "user").withColumn("clean", F.trim("content")).where(F.length("clean") >= least)
    words = lambda c: F.split(F.lower(c), r"\s+")
    before = F.lag("clean").over(Window.partitionBy("conv_id").orderBy("turn"))
    rows = clean.withColumn("before", before).select("id", "clean", words(F.col("clean")).alias("now"), words(F.col("before")).alias("then"))
    fresh = F.when(F.col("then").isNull(), F.array().cast("array<string>")).otherwise(F.filter("now", lambda w: (F.length(w) > 3) & ~F.array_contains("then", w)))
    rows = rows.withColumn("fresh", fresh)
    tail = F.slice("fresh", F.greatest(F.size("fresh") - 49, F.lit(1)), 50)
    return rows.select("id", F.when(F.size("fresh") >= 5, F.array_join(tail, " ")).otherwise(F.substring(F.col("clean"), F.greatest(F.length("clean") - 499, F.lit(1)), F.lit(500))).alias("query"))


def mark_synced(synced: DataFrame, flushed: DataFrame, at_ms: int) -> DataFrame:
    """(conv_id, synced_at) after the conversations of ``flushed`` (conv_id) were sent at ``at_ms``."""
    now = flushed.select("conv_id").distinct().withColumn("synced_at", F.lit(at_ms).cast("long"))
    return synced.select("conv_id", "synced_at").unionByName(now).groupBy("conv_id").agg(F.max("synced_at").alias("synced_at"))


def sync_entry(flushed: DataFrame, at_ms: int, error: str | None = None) -> DataFrame:
    """One row for the sync log: id, timestamp, conversations_flushed, turns_flushed, status, error."""
    one = flushed.agg(F.countDistinct("conv_id").alias("conversations_flushed"), F.count("*").alias("turns_flushed"))
    sent = lambda c: F.col(c) if error is None else F.lit(0).cast("long")
    return one.select(
        F.lit(f"sync_{at_ms}").alias("id"), F.lit(at_ms).cast("long").alias("timestamp"), sent("conversations_flushed").alias("conversations_flushed"), sent("turns_flushed").alias("turns_flushed"),
        F.lit("ok" if error is None else "error").alias("status"), F.lit(error).cast("string").alias("error"),
    )


def sync_log(entries: DataFrame, n: int = 20) -> DataFrame:
    return entries.orderBy(F.desc("timestamp"), "id").limit(n)


def migration_tallies(turns: DataFrame, there: DataFrame, size: int = 25) -> DataFrame:
    """batch, ingested, skipped, errors: turns (conv_id, id, content) that are new, that ``there`` (id) holds, and that have no content."""
    rows = turns.withColumnRenamed("conv_id", "_of").join(migration_batches(turns, size).select("batch", "conv_id"), F.col("_of").eqNullSafe(F.col("conv_id"))).join(there.select("id").distinct().withColumn("known", F.lit(True)), "id", "left")
    bad = F.coalesce(F.trim("content") == "", F.lit(True))
    known = F.coalesce("known", F.lit(False))
    return rows.groupBy("batch").agg(F.count_if(~bad & ~known).alias("ingested"), F.count_if(~bad & known).alias("skipped"), F.count_if(bad).alias("errors"))
