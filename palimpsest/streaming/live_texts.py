"""Server-sent events of chat services as they arrive, reassembled into texts.

A stateful step takes packets of each stream in the order of ``seq``, whatever micro-batch brings
them, and hands on each frame once its line is complete.  Between batches it keeps the unfinished line,
the packets that came before their turn, and where the stream stands.  A stream ends with ``[DONE]``, or when
the watermark shows that nothing came for a while: then what waits is taken as it is, as a batch takes
the last line.

Texts so far are a keyed table: each batch puts its pieces behind those that are there, so a reader
sees a text grow, and a batch that runs again is known by its number.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from palimpsest.functions.values import parsed
from palimpsest.operators import versions
from palimpsest.operators.keyed import KeyedTable
from palimpsest.plans.steps import importable
from palimpsest.sources.sse import frame_text, inner_conversation

FRAMES = "stream_id string, platform string, conversation_id string, at long, frame string, ended boolean"
COLUMNS = [c.split()[0] for c in FRAMES.split(", ")]
TEXTS = "stream_id string, platform string, conversation_id string, inner_id string, content string, last_piece string, chunk_count long, from_at long, ended boolean"


class _Frames(StatefulProcessor):
    """Packets of one stream to its frames."""

    def __init__(self, idle_ms: int, first: int):
        self.idle_ms, self.first = idle_ms, first

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.stands = handle.getValueState("stands", "tail string, next long, at long, done boolean, platform string, conversation_id string, waiting long, timer long")
        self.early = handle.getMapState("early", "seq long", "packet string")

    def _stands(self) -> dict:
        names = ("tail", "next", "at", "done", "platform", "conversation_id", "waiting", "timer")
        found = self.stands.get() if self.stands.exists() else None
        return dict(zip(names, found or ("", self.first, 0, False, None, None, 0, 0)))

    def _row(self, key, s: dict, frame: str | None, ended: bool) -> dict:
        return dict(zip(COLUMNS, (key[0], s["platform"], s["conversation_id"], s["at"], frame, ended)))

    def _lines(self, key, s: dict, lines: list[str], out: list[dict]) -> None:
        for line in lines:
            line = line.strip(" ")
            if s["done"] or not line.startswith("data: "):
                continue
            frame = line[6:].strip(" ")
            if frame.lower() == "[done]":
                s["done"], s["tail"] = True, ""
                out.append(self._row(key, s, None, True))
            else:
                out.append(self._row(key, s, frame, False))
                s["at"] += 1

    def _feed(self, key, s: dict, packet: str, out: list[dict]) -> None:
        *lines, s["tail"] = (s["tail"] + packet).split("\n")
        self._lines(key, s, lines, out)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        s, out, here, last = self._stands(), [], {}, 0
        if not s["timer"]:  # a stream is known from its first packet on, frames or none
            begun = self._row(key, s, None, False)
            out.append(begun)
        for r in (r for batch in rows for r in batch.to_dict("records")):
            s["platform"] = s["platform"] or r["platform"]
            last = max(last, int(r["ts"].timestamp() * 1000))
            if r["conversation_id"] is not None:
                s["conversation_id"] = max(s["conversation_id"] or "", r["conversation_id"])
            if r["seq"] >= s["next"]:  # else it came before
                here.setdefault(int(r["seq"]), r["packet"] or "")
        if not s["timer"]:
            begun |= {"platform": s["platform"], "conversation_id": s["conversation_id"]}
        while not s["done"]:
            packet = here.pop(s["next"], None)
            if s["waiting"] and self.early.containsKey((s["next"],)):
                packet = self.early.getValue((s["next"],))[0]
                self.early.removeKey((s["next"],))
                s["waiting"] -= 1
            if packet is None:
                break
            s["next"] += 1
            self._feed(key, s, packet, out)
        if s["done"]:
            self.early.clear()
            s["waiting"] = 0
        else:
            for seq, packet in here.items():
                if not self.early.containsKey((seq,)):
                    self.early.updateValue((seq,), (packet,))
                    s["waiting"] += 1
        if s["timer"]:
            self.handle.deleteTimer(s["timer"])
        s["timer"] = max(s["timer"], last + self.idle_ms)
        self.handle.registerTimer(s["timer"])
        self.stands.update(tuple(s.values()))
        yield pd.DataFrame(out, columns=COLUMNS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        s, out = self._stands(), []
        if not s["done"]:
            for seq in sorted(k[0] for k in self.early.keys()) if s["waiting"] else []:
                self._feed(key, s, self.early.getValue((seq,))[0], out)
            self._lines(key, s, [s["tail"]], out)
            if not s["done"]:
                out.append(self._row(key, s, None, True))
        self.stands.clear()
        self.early.clear()
        yield pd.DataFrame(out, columns=COLUMNS)

    def close(self) -> None:
        pass


def live_frames(packets: DataFrame, idle_ms: int = 60_000, first: int = 0) -> DataFrame:
    """FRAMES of a stream of ``packets`` (stream_id, platform, conversation_id, seq, packet, ts), as soon as each is complete; needs the RocksDB state store.

    ``ts`` has a watermark.  ``seq`` counts from ``first``; a packet that came before counts once.  A row
    without a frame says that a stream began, or with ``ended`` that it is over.  State goes when the
    watermark is ``idle_ms`` past a stream's last packet; what comes later begins anew.
    """
    importable(packets.sparkSession)
    return packets.groupBy("stream_id").transformWithStateInPandas(statefulProcessor=_Frames(idle_ms, first), outputStructType=FRAMES, outputMode="append", timeMode="EventTime")


def _parts(frames: DataFrame) -> DataFrame:
    got = parsed(frames, "frame")
    got = got.select(*frames.columns, frame_text(F.col("platform"), F.col("json")).alias("piece"), inner_conversation(F.col("json")).alias("inner"))
    pieces = F.transform(F.array_sort(F.collect_list(F.when(F.col("piece").isNotNull(), F.struct("at", "piece")))), lambda p: p["piece"])
    out = got.groupBy("stream_id").agg(
        F.first("platform", ignorenulls=True).alias("platform"), F.max("conversation_id").alias("conversation_id"), F.max("inner").alias("inner_id"), pieces.alias("pieces"),
        F.min("at").alias("from_at"), F.max("ended").alias("ended"),
    )
    return out.select(
        "stream_id", "platform", "conversation_id", "inner_id", F.array_join("pieces", "").alias("content"), F.try_element_at("pieces", F.lit(-1)).alias("last_piece"), F.size("pieces").cast("long").alias("chunk_count"),
        "from_at", "ended",
    )


def _joined(old: DataFrame, new: DataFrame) -> DataFrame:
    """What came now behind what was there: a stream's frames come in order."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.select(*old.columns).withColumn("_new", F.lit(1)))
    content = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_new", "content"))), lambda x: x["content"]), "")
    return both.groupBy("stream_id").agg(
        F.min_by("platform", F.when(F.col("platform").isNotNull(), F.col("_new"))).alias("platform"), F.max("conversation_id").alias("conversation_id"), F.max("inner_id").alias("inner_id"), content.alias("content"),
        F.max_by("last_piece", F.when(F.col("last_piece").isNotNull(), F.col("_new"))).alias("last_piece"), F.sum("chunk_count").alias("chunk_count"), F.min("from_at").alias("from_at"), F.max("ended").alias("ended"),
    )


class LiveTexts:
    """The table of texts at ``path``."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 32):
        self.spark, self.path = spark, path.rstrip("/")
        if not versions.latest(spark, self.path)[0]:
            KeyedTable.create(spark, self.path, TEXTS, "stream_id", buckets)

    def arrive(self, frames: DataFrame, number: int) -> None:
        """Put the frames of a batch, the ``number``-th, behind those that are there; a sink for ``foreachBatch``."""
        table = KeyedTable(self.spark, self.path)
        if table.notes.get("batch", -1) < number:
            frames = frames.persist()  # the stateful step is run once
            try:
                table.change(_parts(frames), _joined, batch=number)
            finally:
                frames.unpersist()

    def texts(self, mode: str = "concat") -> DataFrame:
        """stream_id, platform, conversation_id, content, chunk_count, ended; as ``sse.reassemble`` of what came so far."""
        content = F.col("content") if mode == "concat" else F.when(F.col("platform") == "chatgpt", F.coalesce("last_piece", F.lit(""))).otherwise(F.col("content"))
        return KeyedTable(self.spark, self.path).read().select("stream_id", "platform", F.coalesce("conversation_id", "inner_id").alias("conversation_id"), content.alias("content"), "chunk_count", "ended")

    def following(self, packets: DataFrame, checkpoint: str, idle_ms: int = 60_000, late: str = "1 minute", every: str | None = None) -> StreamingQuery:
        """Start a query that reassembles a stream of packets, or what there is of it now; packets more than ``late`` behind may be lost."""
        out = live_frames(packets.withWatermark("ts", late), idle_ms).writeStream.foreachBatch(self.arrive).outputMode("append").option("checkpointLocation", checkpoint)
        return (out.trigger(processingTime=every) if every else out.trigger(availableNow=True)).start()
