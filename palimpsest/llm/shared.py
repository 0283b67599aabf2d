"""Tables, the shared folder and byte files that every operator here uses.

Intermediate tables go to the folder the cluster names in ``spark.checkpoint.dir``;
driver and executors both see it.  Only where that is unset (tests, a laptop) and the
master is local does a temporary folder stand in.
"""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A row's file, hashed, and its place in it.
FILE, ROW = "__file", "__row"
ROW_KEY = [FILE, ROW]
#: At most so many row keys are broadcast, which takes some 100 MB.
MOST_KEYS = 1_000_000


def importable(spark: SparkSession) -> None:
    """Let Python workers find this package where the driver found it, whatever folder they start in."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    spark.conf.set("spark.checkpoint.dir", "file://" + tempfile.mkdtemp(prefix="palimpsest-"))
    return spark.conf.get("spark.checkpoint.dir")


_scratch: list[list[str]] = []


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path of its own in the shared folder."""
    path = f"{shared_root(spark)}/palimpsest/{name}-{uuid.uuid4().hex[:12]}"
    if _scratch:
        _scratch[-1].append(path)
    return path


def forget(spark: SparkSession, *paths: str) -> None:
    """Delete intermediate tables that nothing reads any more."""
    for path in paths:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """What steps inside put into the shared folder goes at the end; results that read it must be written by then."""
    _scratch.append([])
    try:
        yield
    finally:
        forget(spark, *_scratch.pop())


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write and reread: cuts the lineage, and survives lost executors."""
    return written(df, shared_path(df.sparkSession, name))


def written(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _aside(names: list[str]) -> list[str]:
    """``names``, with underscores after those that are names of the row key, until none is there twice."""
    taken = {n.lower() for n in [*names, *ROW_KEY]}
    out = []
    for name in names:
        if name.lower() in ROW_KEY:
            while name.lower() in taken:
                name += "_"
            taken.add(name.lower())
        out.append(name)
    return out


def with_row_key(docs: DataFrame) -> DataFrame:
    """``docs`` with FILE and ROW, which tell equal rows apart and are the same whenever a row is read again.

    They come from the files that hold the rows; what is not a plain read of files is stored first.
    Columns of ``docs`` that have one of these names, in any case, get another; ``without_rows`` gives theirs back.
    """
    if docs._jdf.queryExecution().analyzed().children().isEmpty():
        try:
            at = docs.metadataColumn("_metadata")
            keyed = docs.select("*", F.xxhash64(at["file_path"]).alias(FILE), at["row_index"].alias(ROW))
            return keyed.toDF(*_aside(docs.columns), *ROW_KEY)
        except AnalysisException:
            pass
    return with_row_key(stored(docs, "rows"))


def bounded(table: DataFrame) -> DataFrame:
    """A stored table of a few numbers a row, to be broadcast if it has at most MOST_KEYS rows."""
    return F.broadcast(table) if table.limit(MOST_KEYS + 1).count() <= MOST_KEYS else table


def without_rows(keyed: DataFrame, gone: DataFrame, names: list[str]) -> DataFrame:
    """Rows of ``keyed``, from ``with_row_key``, that ``gone`` (FILE, ROW: a stored table) does not name, without their key, columns called ``names``.

    Up to MOST_KEYS keys are broadcast and no text moves; beyond that Spark joins by exchange.
    """
    return keyed.join(bounded(gone), ROW_KEY, "left_anti").drop(*ROW_KEY).toDF(*names)


def filesystem(path: str):
    """(pyarrow file system, path in it) of a shared path, for code on executors."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    if "://" not in path:
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path)


def write_bytes(path: str, chunks) -> None:
    """Write under another name and rename: a retried task replaces a whole file by an equal one."""
    files, at = filesystem(path)
    files.create_dir(os.path.dirname(at), recursive=True)
    with files.open_output_stream(own := f"{at}.{uuid.uuid4().hex[:8]}") as out:
        for c in chunks:
            out.write(c)
    files.move(own, at)


def small(batches, rows: int = 1000):
    """The record batches in parts of ``rows`` rows, so that few texts are Python objects at once."""
    for b in batches:
        for at in range(0, len(b), rows):
            yield b.slice(at, rows)


def give_back(encoders: bool = True) -> None:
    """Return freed memory to the system, and drop the tokenizers' memos; workers live on between tasks."""
    import ctypes
    import sys

    import pyarrow as pa

    if encoders and (chunks := sys.modules.get("palimpsest.llm.chunks")):
        chunks.encoder.cache_clear()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass
