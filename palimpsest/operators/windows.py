"""Event-time windows, grouping sets, as-of joins and approximate counts over plain tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def tumbling(events: DataFrame, size: str) -> DataFrame:
    w = F.window("ts", size)
    return events.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, size: str, step: str) -> DataFrame:
    return events.groupBy(F.window("ts", size, step).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str) -> DataFrame:
    return events.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """``left`` with the value of the last ``right`` row of its key at or before it: one union and one window, no range join."""
    rows = left.withColumns({"_side": F.lit(1), "_value": F.lit(None).cast(dict(right.dtypes)[value])}).unionByName(right.select(key, at, F.lit(0).alias("_side"), F.col(value).alias("_value")), allowMissingColumns=True)
    before = Window.partitionBy(key).orderBy(at, "_side").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(value, F.last("_value", ignorenulls=True).over(before)).where("_side = 1").select(*left.columns, value)
