"""Keyed tables without a lakehouse format: upsert, deletion, bounded logs, export and import."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def upsert(rows: DataFrame, key: str, *version: str) -> DataFrame:
    """Of rows with one key the latest by version, whole; tasks hand on one row of each key."""
    latest = rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), F.struct(*version)).alias("_row"))
    return latest.select("_row.*")


def merged(table: DataFrame, imported: DataFrame, key: str) -> DataFrame:
    """``table`` after ``imported`` rows were put into it: of one key the imported row counts."""
    both = table.withColumn("_put", F.lit(0)).unionByName(imported.withColumn("_put", F.lit(1)), allowMissingColumns=True)
    return upsert(both, key, "_put").drop("_put")


def overwritten(table: DataFrame, path: str) -> DataFrame:
    """``table`` as the new whole of what is at ``path``."""
    table.write.mode("overwrite").parquet(path)
    return table.sparkSession.read.schema(table.schema).parquet(path)


def cleared(*tables: DataFrame) -> list[DataFrame]:
    """The tables without their rows."""
    return [t.limit(0) for t in tables]


def point(table: DataFrame, key: str, value) -> DataFrame:
    return table.where(F.col(key) == F.lit(value))


def setting(settings: DataFrame, key: str, default: str) -> DataFrame:
    """One row: the value of a key, or the default."""
    return settings.where(F.col("key") == key).agg(F.coalesce(F.max("value"), F.lit(default)).alias("value"))


def without_keys(table: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return table.join(gone.select(key), key, "left_anti")


def purge(docs: DataFrame, marker: str) -> DataFrame:
    return docs.where(~F.coalesce(F.col("content").contains(marker), F.lit(False)))


def ring(rows: DataFrame, by: str, seq: str, n: int) -> DataFrame:
    """The newest n of each value of ``by``."""
    at = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(seq)))
    return rows.withColumn("_at", at).where(F.col("_at") <= n).drop("_at")


def evict(docs: DataFrame, most: int = 2000, slack: int = 10) -> DataFrame:
    """Once there are ``most`` + ``slack`` docs or more, the newest ``most``; a top-n, not a sort of all."""
    n = docs.agg(F.count("*").alias("_n"))
    newest = docs.orderBy(F.desc("ts_ms"), F.desc("id")).limit(most + slack)
    place = F.row_number().over(Window.orderBy(F.desc("ts_ms"), F.desc("id")))
    return newest.withColumn("_at", place).join(F.broadcast(n)).where((F.col("_n") < most + slack) | (F.col("_at") <= most)).drop("_at", "_n")


def newest(rows: DataFrame, seq: str, n: int) -> DataFrame:
    return rows.orderBy(F.desc(seq)).limit(n)


def export_json(conversation_turns: DataFrame, path: str) -> None:
    """A JSON object for each conversation, with its turns, in files under ``path``."""
    turn = F.struct("turn", "id", "role", "content", "ts_ms")
    conversation_turns.groupBy("conv_id", "platform").agg(F.array_sort(F.collect_list(turn)).alias("turns")).write.mode("overwrite").json(path)


def export_rows(conversation_turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, payload: what ``export_json`` writes, as text."""
    turn = F.struct("turn", "id", "role", "content", "ts_ms")
    per = conversation_turns.groupBy("conv_id", "platform").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    return per.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.to_json(F.struct("platform", "turns")).alias("payload"))


EXPORTED = "platform string, turns array<struct<turn:long,id:string,role:string,content:string,ts_ms:long>>"


def imported(rows: DataFrame, payload: Column) -> DataFrame:
    """Turns again from exported payloads of ``rows`` (conv_id, ...)."""
    parsed = rows.select("conv_id", F.from_json(payload, EXPORTED).alias("p"))
    return parsed.select("conv_id", F.col("p.platform").alias("platform"), F.inline("p.turns"))


def import_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("conv_id long, " + EXPORTED).json(path).select("conv_id", "platform", F.inline("turns"))


def stripped_for_reembedding(vectors: DataFrame) -> DataFrame:
    """What a move to another vector model takes along: texts, never vectors."""
    return vectors.select("id", "text", "created_at")


PARTS = ("conversations", "facts", "settings", "syncLog")


MANIFEST = "version int, exportedAt string, parts array<string>, folder string"


def export_all(path: str, version: int, exported_at: str, newest: int = 100, **data: DataFrame) -> None:
    """An export: ``manifest`` (version, exportedAt, the parts and their folder) and JSON rows of the parts given, of PARTS.

    Of a syncLog (timestamp) the ``newest`` entries are taken.  Each export has a folder of its own and
    its manifest comes last, so one that dies on its way is none, and what was there before is whole
    until the new manifest takes its place.
    """
    spark = next(iter(data.values())).sparkSession
    if unknown := sorted(set(data) - set(PARTS)):
        raise ValueError(f"no part of an export: {', '.join(unknown)}")
    folder = f"data-{uuid.uuid4().hex[:12]}"
    for name, rows in data.items():
        if name == "syncLog":
            rows = rows.orderBy(F.desc("timestamp"), *[c for c in rows.columns if c != "timestamp"]).limit(newest)
        rows.write.json(f"{path}/{folder}/{name}")
    one = spark.createDataFrame([(version, exported_at, sorted(data), folder)], MANIFEST)
    one.coalesce(1).write.mode("overwrite").json(f"{path}/manifest")


def import_all(spark: SparkSession, path: str, schemas: dict[str, str]) -> dict[str, DataFrame]:
    """The parts of an export, read by ``schemas``; a part that it lacks is empty.  ValueError where there is no export."""
    from pyspark.errors import AnalysisException

    try:
        manifest = spark.read.schema(MANIFEST).json(f"{path}/manifest").first()
    except AnalysisException:
        manifest = None
    if manifest is None or manifest["parts"] is None:
        raise ValueError("Invalid export format")
    return {name: spark.read.schema(schema).json(f"{path}/{manifest['folder'] or 'data'}/{name}") if name in manifest["parts"] else spark.createDataFrame([], schema) for name, schema in schemas.items()}
