"""Conversations kept up to date as turns arrive, in whatever order.

Turns go into a keyed table by id, each once.  What is new goes into a second one, a
conversation's roll-up in parts that any order of additions leaves the same: first turn, first user
message, last time, counts.  A late turn counts like any other, for no watermark drops it.

Both tables note the batch they hold.  A batch that runs again after a failure finds what it had
done: turns carry the number of the batch that brought them, so the second step goes on where the
first ended.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from palimpsest.functions.text import token_estimate, truncated
from palimpsest.operators import versions
from palimpsest.operators.keyed import KeyedTable

TURNS = "id string, conv_id long, platform string, turn long, role string, content string, ts_ms long, batch long"
PARTS = "conv_id long, first struct<turn:long,ts_ms:long,id:string,platform:string>, title struct<turn:long,ts_ms:long,id:string,content:string>, updated_at long, turn_count long, chars long"


def _parts(turns: DataFrame) -> DataFrame:
    at = lambda x: F.struct("turn", "ts_ms", "id", x)
    return turns.groupBy("conv_id").agg(
        F.min(at("platform")).alias("first"),
        F.min(F.when(F.col("role") == "user", at(truncated(F.col("content"), 120).alias("content")))).alias("title"),
        F.max("ts_ms").alias("updated_at"),
        F.count("*").alias("turn_count"),
        F.coalesce(F.sum(F.length("content")), F.lit(0)).cast("long").alias("chars"),
    )


def _merged(old: DataFrame, new: DataFrame) -> DataFrame:
    """Parts of one conversation put together."""
    both = old.unionByName(new.select(*old.columns))
    return both.groupBy("conv_id").agg(F.min("first").alias("first"), F.min("title").alias("title"), F.max("updated_at").alias("updated_at"), F.sum("turn_count").alias("turn_count"), F.sum("chars").alias("chars"))


class Conversations:
    """The two tables under ``path``."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path = spark, path.rstrip("/")
        for name, schema, key in (("turns", TURNS, "id"), ("rollup", PARTS, "conv_id")):
            if not versions.latest(spark, f"{self.path}/{name}")[0]:
                KeyedTable.create(spark, f"{self.path}/{name}", schema, key, buckets)

    def _table(self, name: str) -> KeyedTable:
        return KeyedTable(self.spark, f"{self.path}/{name}")

    def arrive(self, batch: DataFrame, number: int) -> None:
        """Take in ``batch`` (id, conv_id, platform, turn, role, content, ts_ms), the ``number``-th from 0; a sink for ``foreachBatch``.

        Of turns with one id the one that came first counts, within a batch the earliest.
        """
        turns, rollup = self._table("turns"), self._table("rollup")
        if turns.notes.get("batch", -1) < number:
            turns = turns.add(batch.withColumn("batch", F.lit(number).cast("long")), "ts_ms", "turn", "content", batch=number)
        if rollup.notes.get("batch", -1) < number:
            fresh = turns.read().where(F.col("batch") == number)
            rollup.change(_parts(fresh), _merged, batch=number)

    def turns(self) -> DataFrame:
        return self._table("turns").read().drop("batch")

    def rollup(self) -> DataFrame:
        """As ``conversation.rollup`` of all turns that came."""
        return self._table("rollup").read().select(
            "conv_id", F.col("first.platform").alias("platform"), F.coalesce("title.content", F.lit("(untitled)")).alias("title"), F.col("first.ts_ms").alias("started_at"), "updated_at", "turn_count",
            token_estimate(F.col("chars")).alias("token_estimate"),
        )

    def following(self, turns: DataFrame, checkpoint: str, every: str | None = None) -> StreamingQuery:
        """Start a query that takes in a stream of turns, or what there is of it now."""
        out = turns.writeStream.foreachBatch(self.arrive).option("checkpointLocation", checkpoint)
        return (out.trigger(processingTime=every) if every else out.trigger(availableNow=True)).start()
