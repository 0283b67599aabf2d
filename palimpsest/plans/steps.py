"""Cutting a plan where several later steps read it."""

from __future__ import annotations

import functools
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def importable(spark: SparkSession) -> None:
    """Let Python workers find this package where the driver found it, whatever folder they start in."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])


def shared_root(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only where that is unset and the master local."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return (named or _temporary()).rstrip("/")


@functools.cache
def _temporary() -> str:
    return "file://" + tempfile.mkdtemp(prefix="palimpsest-")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path of its own in the shared folder."""
    return f"{shared_root(spark)}/palimpsest/{name}-{uuid.uuid4().hex[:12]}"


def materialised(df: DataFrame) -> DataFrame:
    """A table written to the shared folder and read again; a checkpoint would compute its rows twice."""
    path = shared_path(df.sparkSession, "step")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node reachable from each node of ``edges`` (a, b: bigint).

    In turn every node's greater neighbours move to its least neighbour, and its smaller ones do,
    until nothing moves; the number of rounds is of the order of the squared logarithm of the nodes.
    """
    down = lambda df: df.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    state = lambda df: df.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
    pairs = materialised(down(edges))
    before = state(pairs)
    while True:
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = materialised(down(pairs.select(F.col("b").alias("a"), F.col("a").alias("far")).join(least, "a").select(F.col("far").alias("a"), F.col("m").alias("b"))))
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        pairs = materialised(down(moved.unionByName(low.select("a", F.col("m").alias("b")))))
        now = state(pairs)
        if now == before:
            return pairs.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(pairs.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
        before = now
