"""Tables and indexes made from the given tables, kept in the shared folder for the queries to come.

They go by what they are made from: names, lengths and times of the files.  Other files give
others; a copy that was not finished is made anew.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from palimpsest.operators import versions
from palimpsest.operators.search_index import SearchIndex
from palimpsest.plans.steps import shared_root
from palimpsest.sources import views


def _path(spark: SparkSession, name: str, *sources: DataFrame) -> str:
    digest = hashlib.sha256(name.encode())
    for df in sources:
        for f in sorted(df.inputFiles()):
            p, fs = versions._path(spark, f)
            s = fs.getFileStatus(p)
            digest.update(f"{f} {s.getLen()} {s.getModificationTime()}\n".encode())
    return f"{shared_root(spark)}/palimpsest/kept-{name}-{digest.hexdigest()[:24]}"


def kept(spark: SparkSession, name: str, made: Callable[[], DataFrame], *sources: DataFrame) -> DataFrame:
    """The table ``made()``, written once for the files of ``sources``."""
    path = _path(spark, name, *sources)
    p, fs = versions._path(spark, f"{path}/_SUCCESS")
    if not fs.exists(p):
        made().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def turn_index(spark: SparkSession, sf_dir: str) -> SearchIndex:
    """The keyword index over all conversation turns."""
    path = _path(spark, "turn-index", views.table(spark, sf_dir, "conversations"))
    number = versions.latest(spark, path)[0]
    index = SearchIndex(spark, path) if number else SearchIndex.create(spark, path)
    if index.number == 1:  # nothing was added yet
        try:
            index = index.add(views.turns(spark, sf_dir), new=True)
        except versions.Conflict:
            index = SearchIndex(spark, path)
    return index
