"""Turns as a stream: watermarked removal of repeats, session windows, and flushing once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StructType

from palimpsest.operators.retrieval import embedded
from palimpsest.plans.steps import importable

TURN = "id string, conv_id long, role string, content string, ts_ms long"


def read_turns(spark: SparkSession, path: str, per_trigger: int = 100) -> DataFrame:
    """A stream over JSON files of turns, with event time."""
    return spark.readStream.schema(TURN).option("maxFilesPerTrigger", per_trigger).json(path).withColumn("ts", F.timestamp_millis("ts_ms"))


def distinct_turns(turns: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Each id once; its state goes when the watermark has passed."""
    return turns.withWatermark("ts", late).dropDuplicatesWithinWatermark(["id"])


def turn_counts(turns: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Turns by conversation and session."""
    grouped = turns.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "conv_id")
    return grouped.agg(F.count("*").alias("n")).select("conv_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


class _Echoes(StatefulProcessor):
    """Keeps the last accepted turns of a conversation, until the watermark is ``ttl_ms`` past them, and lets pass what repeats none of them."""

    def __init__(self, window_ms: int = 5_000, back: int = 5, ttl_ms: int = 3_600_000):
        self.window_ms, self.back, self.ttl_ms = window_ms, back, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getListState("last", "role string, content string, ts_ms long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last = [tuple(r) for r in self.last.get()]
        out = []
        for r in sorted((r for batch in rows for r in batch.to_dict("records")), key=lambda r: r["ts_ms"]):
            if any(a == r["role"] and b == r["content"] and abs(t - r["ts_ms"]) < self.window_ms for a, b, t in last[-self.back :]):
                continue
            last = sorted([*last, (r["role"], r["content"], int(r["ts_ms"]))], key=lambda x: x[2])[-self.back :]
            out.append({k: r[k] for k in ("id", "conv_id", "role", "content", "ts_ms")})
        if last:
            self.last.put(last)
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            self.handle.registerTimer(last[-1][2] + self.ttl_ms)
        yield pd.DataFrame(out, columns=["id", "conv_id", "role", "content", "ts_ms"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.clear()
        yield pd.DataFrame([], columns=["id", "conv_id", "role", "content", "ts_ms"])

    def close(self) -> None:
        pass


def without_echoes(turns: DataFrame, ttl_ms: int = 3_600_000) -> DataFrame:
    """The stream's turns without those that repeat one of the last five accepted within five seconds; needs the RocksDB state store.

    ``turns`` have a watermark on ``ts``: what comes later than it allows is dropped, what comes out of
    order within a batch is put in order, and the state of a conversation goes when the watermark is
    ``ttl_ms`` past its last turn.
    """
    importable(turns.sparkSession)
    schema = StructType.fromDDL(TURN)
    return turns.groupBy("conv_id").transformWithStateInPandas(statefulProcessor=_Echoes(ttl_ms=ttl_ms), outputStructType=schema, outputMode="append", timeMode="EventTime")


def flush_once(path: str):
    """A sink for ``foreachBatch``: a batch writes a folder of its own, so one that is run again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").json(f"{path}/batch={number}")

    return write


def flushing(turns: DataFrame, path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Start a query that writes turns once: a batch each ``every`` ("2 minutes"), in which what came meanwhile waits, or all there is now."""
    out = turns.writeStream.foreachBatch(flush_once(path)).option("checkpointLocation", checkpoint)
    return (out.trigger(processingTime=every) if every else out.trigger(availableNow=True)).start()


def embedding(turns: DataFrame, embed: Callable[[Column], Column], path: str, checkpoint: str, per_batch: Callable[[DataFrame], DataFrame] = lambda b: b) -> StreamingQuery:
    """Start a query that appends the vectors of new turns to a table; what waits is in the source, and a restart goes on from the checkpoint."""

    def write(batch: DataFrame, number: int) -> None:
        embedded(per_batch(batch), embed).select("id", "vector").write.mode("overwrite").parquet(f"{path}/batch={number}")

    return turns.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
