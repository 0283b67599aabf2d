"""A graph's neighbours as a stored table, for walks of any number of hops.

Edges lie in buckets of (name, part): a hub of more than ``most`` neighbours has them in several
parts, by hash of the neighbour, so that no bucket gets a hub whole, and a step over the
table exchanges the front of the walk and not the edges.  What is visited is a table of its own, to
which each hop adds its rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.plans.steps import materialised, shared_path


@dataclass
class Adjacency:
    """edges (name, part, neighbour, confidence), both ways, once each; hubs (name, parts: how many, 2 or more)."""

    edges: DataFrame
    hubs: DataFrame
    table: str

    def forget(self) -> None:
        self.edges.sparkSession.sql(f"DROP TABLE IF EXISTS {self.table}")


def stored_adjacency(rels: DataFrame, most: int = 10_000, buckets: int = 64) -> Adjacency:
    """The neighbours in ``rels`` (from, to, confidence); of repeated relations the greatest confidence counts.

    Relations with a null end are passed over; a null confidence is below any other.
    ``buckets`` should be some tasks' worth of the edges, several for each executor core.
    """
    spark = rels.sparkSession
    there = rels.select(F.col("from").alias("name"), F.col("to").alias("neighbour"), "confidence").where("name IS NOT NULL AND neighbour IS NOT NULL")
    both = there.unionByName(there.select(F.col("neighbour").alias("name"), F.col("name").alias("neighbour"), "confidence"))
    # keyed by both ends, a hub's rows are spread over all tasks
    edges = materialised(both.groupBy("name", "neighbour").agg(F.max("confidence").alias("confidence")))
    # at most a row for each `most` edges; its size is known once it is stored, and Spark broadcasts it or not
    parts = F.ceil(F.count("*") / most).cast("int")
    hubs = materialised(edges.groupBy("name").agg(parts.alias("parts")).where("parts > 1"))
    part = F.coalesce(F.pmod(F.xxhash64("neighbour"), F.col("parts")).cast("int"), F.lit(0))
    placed = edges.join(hubs, "name", "left").select("name", part.alias("part"), "neighbour", "confidence")
    table = f"adjacency_{uuid.uuid4().hex[:12]}"
    placed.repartition(buckets, "name", "part").write.bucketBy(buckets, "name", "part").sortBy("name", "part").option("path", shared_path(spark, "adjacency")).saveAsTable(table)
    return Adjacency(spark.table(table), hubs, table)


def walked(graph: Adjacency, start: DataFrame, hops: int = 2, least: float = 0.5, by: Sequence[str] = ()) -> DataFrame:
    """``by``, name, hop: the least number of hops to all within ``hops`` of ``start`` (``by``, name), over edges of confidence ``least`` or more.

    ``by`` tells walks apart, such as queries, and is never null.  Names that the graph does not have stay at hop 0; null names are passed over.
    """
    key = [*by, "name"]
    strong = graph.edges.where(F.col("confidence") >= least).select("name", "part", "neighbour")
    front = visited = materialised(start.where("name IS NOT NULL").select(*key, F.lit(0).alias("hop")).distinct())
    for hop in range(1, hops + 1):
        parts = F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)
        asked = front.join(graph.hubs, "name", "left").select(*key, F.explode(parts).alias("part"))
        reached = asked.join(strong, ["name", "part"]).select(*by, F.col("neighbour").alias("name")).distinct()
        front = materialised(reached.join(visited.select(*key), key, "left_anti").withColumn("hop", F.lit(hop)))
        if front.isEmpty():
            break
        visited = visited.unionByName(front)
    return visited
