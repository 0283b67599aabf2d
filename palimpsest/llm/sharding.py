"""Shards by longest-processing-time scheduling.

Rows with equal texts form a group that stays together.  Groups in falling size order each go
to the shard with the least load, the lowest-numbered of equals.  Groups of one size are alike to
that rule, so it runs over a histogram, the distinct sizes with the number of groups of each, and
not over the groups.  Few groups of a size pass through the heap one by one; many are dealt by the
level that the heap would reach, and the last of them through the heap.  Sizes are exact, whatever
they are.  The rule goes from size to size, so one task reads the histogram, in falling order, and
keeps no more than the shards' loads; it has a row for each distinct size, at most 65,536 of groups
below 64 KiB and at most one for each group above.  Groups then find their shard by their rank
within the size, which comes from a range sort and prefix sums, and slots within a shard come about
in the same way.

Null text has no bytes (size 8, crc32 0) and shares a group with the empty text.  Repeated rows
are rows of their own in one group; groups of one size take shards in the order of their digests;
texts may be of any length, only their sizes and digests are sorted; further columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import heapq

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.shared import read_table, stored


def deal(loads: list[int], size: int, count: int) -> list[int]:
    """How many of ``count`` groups of a size each shard gets; ``loads`` grow by them."""
    got = [0] * len(loads)
    if count > 8 * len(loads) and size > 0:
        # the highest level to which all shards can be filled with at most `count` groups
        low, high = min(loads), max(loads) + size * (count // len(loads) + 2)
        need = lambda level: [max(0, (level - x) // size) for x in loads]
        while high - low > 1:
            middle = (low + high) // 2
            low, high = (middle, high) if sum(need(middle)) <= count else (low, middle)
        got = need(low)
    heap = [(x + n * size, i) for i, (x, n) in enumerate(zip(loads, got))]
    heapq.heapify(heap)
    for _ in range(count - sum(got)):
        x, i = heap[0]
        got[i] += 1
        heapq.heapreplace(heap, (x + size, i))
    for x, i in heap:
        loads[i] = x
    return got


def _dealer(shards: int):
    def run(batches):
        loads = [0] * shards
        for b in batches:
            until = []
            for size, count in zip(b.column("bytes").to_pylist(), b.column("n").to_pylist()):
                total = 0
                until.append([total := total + n for n in deal(loads, size, count)])
            yield pa.RecordBatch.from_arrays([b.column("bytes"), pa.array(until, pa.list_(pa.int64()))], ["bytes", "until"])

    return run


def _numbered(df: DataFrame, name: str, *order: str) -> DataFrame:
    """Rows in a total order over partitions, written with their partition and their place in it."""
    at = F.monotonically_increasing_id()
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order)
    return stored(ordered.withColumn("at", at).withColumns({"part": F.expr("CAST(shiftright(at, 33) AS INT)"), "at": F.expr("at & 8589934591")}), name)


def assign_shards(docs: DataFrame, shards: int = 24) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row of ``docs`` (doc_id, text)."""
    text = F.coalesce("text", F.lit(""))
    keyed = stored(
        docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("content")),
        "sizes",
    )
    groups = _numbered(keyed.groupBy("content").agg(F.sum("size").alias("bytes")), "groups", "bytes", "content")
    # a size may go over several partitions: its groups' ranks follow from counts by partition
    runs = stored(groups.groupBy("part", "bytes").agg(F.count("*").alias("n"), F.min("at").alias("first")), "runs")
    sizes = runs.groupBy("bytes").agg(F.sum("n").alias("n"))
    # a constant key: all sizes come to one task, which streams them
    dealt = stored(sizes.repartition(F.lit(0)).sortWithinPartitions(F.desc("bytes")).mapInArrow(_dealer(shards), "bytes long, until array<long>"), "dealt")
    earlier = F.expr("sum(n) OVER (PARTITION BY bytes ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - n")
    plan = stored(runs.select("part", "bytes", (F.col("first") - earlier).alias("less")).join(dealt, "bytes"), "plan")
    placed = groups.join(plan, ["part", "bytes"]).select("content", F.size(F.filter("until", lambda u: u <= F.col("at") - F.col("less"))).alias("shard"))

    rows = _numbered(keyed.join(placed, "content"), "shards", "shard", "content", "doc_id")
    starts = rows.groupBy("shard", "part").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = F.expr("sum(n) OVER (PARTITION BY shard ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - n - first")
    starts = starts.select("shard", "part", before.alias("more"))
    return rows.join(starts, ["shard", "part"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("at") + F.col("more")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def op3_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(read_table(spark, sf_dir, "documents"))
