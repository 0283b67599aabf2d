"""Connected components as DataFrame joins, none of it on the driver.

Large-star and small-star steps in turn: in a large step every node's greater neighbours move to
its least neighbour, in a small step its smaller ones do.  A third of all edges may be at one node:
minima are taken before any exchange, and both sides of a join on the node are written first, so
that each is an exchange of its own and Spark can split it.  What is written is in the shared
folder, which also cuts the lineage; each round deletes what the one before it wrote.  Every round
moves edges to lesser nodes until all are stars, which takes a number of rounds of the order of
the squared logarithm of the number of nodes, so there is no cap on them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.shared import forget, scratch, shared_path, stored, written


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node reachable from every node of ``edges`` (a, b: bigint)."""
    spark = edges.sparkSession
    at = shared_path(spark, "edges")
    pairs = written(_down(edges), at)
    before = _sum(pairs)
    while True:
        to = shared_path(spark, "edges")
        with scratch(spark):
            nxt = written(_small_star(_large_star(pairs)), to)
        now = _sum(nxt)
        forget(spark, at)
        # the same set of edges twice means that all are stars
        if now == before:
            roots = nxt.select(F.col("a").alias("node"), F.col("b").alias("root"))
            return roots.unionByName(nxt.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
        pairs, at, before = nxt, to, now


def _down(edges: DataFrame) -> DataFrame:
    """Distinct edges from the greater to the lesser node; loops go."""
    return edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _sum(pairs: DataFrame):
    return pairs.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.pmod(F.xxhash64("b", "a"), F.lit(1 << 31)))).first()


def _large_star(pairs: DataFrame) -> DataFrame:
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = stored(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")
    greater = pairs.select(F.col("b").alias("a"), F.col("a").alias("far"))
    return _down(greater.join(least, "a").select(F.col("far").alias("a"), F.col("m").alias("b")))


def _small_star(pairs: DataFrame) -> DataFrame:
    pairs = stored(pairs, "edges")
    least = stored(pairs.groupBy("a").agg(F.min("b").alias("m")), "least")
    moved = pairs.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return _down(moved.unionByName(least.select("a", F.col("m").alias("b"))))
