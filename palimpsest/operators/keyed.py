"""A keyed table in hash buckets: changes to a few keys rewrite the buckets of those keys alone."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from palimpsest.operators import versions
from palimpsest.operators.tables import upsert

BUCKET = "__bucket"


class KeyedTable:
    """Rows of one key column at ``path``, at most one for each key.

    Every change writes the touched buckets anew, under the next version, and names them in its
    manifest (see ``versions``).  Rows are dealt to buckets by a hash of their key, and rows with one key
    are merged before they meet, so no key makes a bucket large.  A null key is a key like any other.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.number, self.about = versions.latest(spark, self.path)
        if not self.about:
            raise ValueError(f"no keyed table at {path}")
        self.key, self.buckets = self.about["key"], self.about["buckets"]
        self.schema = StructType.fromJson(self.about["schema"])

    @classmethod
    def create(cls, spark: SparkSession, path: str, schema: StructType | str, key: str, buckets: int = 64) -> KeyedTable:
        """A new table without rows; some 100 MB a bucket is a good size."""
        kinds = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
        versions.commit(spark, path.rstrip("/"), 1, {"key": key, "buckets": buckets, "schema": kinds.jsonValue(), "files": {}, "notes": {}})
        return cls(spark, path)

    @property
    def notes(self) -> dict:
        """What the last change noted, such as the number of a stream's batch."""
        return self.about["notes"]

    def _bucket(self):
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def _of(self, buckets) -> DataFrame:
        """Rows of some buckets; only their files are read."""
        files = self.about["files"]
        found = [f"{self.path}/data/{files[str(b)]}/{BUCKET}={b}" for b in buckets if str(b) in files]
        return self.spark.read.schema(self.schema).parquet(*found) if found else self.spark.createDataFrame([], self.schema)

    def read(self) -> DataFrame:
        return self._of(range(self.buckets))

    def lookup(self, *keys) -> DataFrame:
        """Rows of the keys, from their buckets' files."""
        kind = self.schema[self.key].dataType
        wanted = self.spark.createDataFrame([(k,) for k in keys], StructType().add(self.key, kind))
        buckets = [r[0] for r in wanted.select(self._bucket()).distinct().collect()]
        return self._of(buckets).where(F.col(self.key).isin(list(keys)))

    def change(self, rows: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame], **notes) -> KeyedTable:
        """The table after ``merge(old rows, rows)`` took the place of each bucket that ``rows`` has keys in.

        ``merge`` sees whole buckets; it must give back one row for each key.  ``rows`` are read twice.
        """
        touched = sorted(r[0] for r in rows.select(self._bucket().alias("b")).distinct().collect())  # a number for each bucket at most
        files = dict(self.about["files"])
        if touched:
            new = merge(self._of(touched), rows).select(*self.schema.names).withColumn(BUCKET, self._bucket())
            folder = versions.folder(self.path, self.number + 1)
            new.repartition(len(touched), BUCKET).write.partitionBy(BUCKET).parquet(folder)
            written = {str(r[0]) for r in self.spark.read.parquet(folder).select(BUCKET).distinct().collect()} if _has_files(self.spark, folder) else set()
            for b in map(str, touched):
                files.pop(b, None)
                if b in written:
                    files[b] = folder.rpartition("/")[2]
        versions.commit(self.spark, self.path, self.number + 1, self.about | {"files": files, "notes": self.notes | notes})
        return KeyedTable(self.spark, self.path)

    def put(self, rows: DataFrame, *version: str, **notes) -> KeyedTable:
        """The table with ``rows``: of one key the row of the greatest ``version`` columns stays, a new row before an old one where they are equal."""

        def merge(old: DataFrame, new: DataFrame) -> DataFrame:
            both = old.withColumn("__put", F.lit(0)).unionByName(new.select(*self.schema.names).withColumn("__put", F.lit(1)))
            return upsert(both, self.key, *version, "__put")

        return self.change(rows, merge, **notes)

    def add(self, rows: DataFrame, *first: str, **notes) -> KeyedTable:
        """The table with those of ``rows`` whose keys it lacks, of one key the least by ``first`` columns."""

        def merge(old: DataFrame, new: DataFrame) -> DataFrame:
            one = new.groupBy(self.key).agg(F.min_by(F.struct(*self.schema.names), F.struct(*first)).alias("_row")).select("_row.*")
            return old.unionByName(one.join(old.select(F.col(self.key).alias("__k")), F.col(self.key).eqNullSafe(F.col("__k")), "left_anti"))

        return self.change(rows, merge, **notes)

    def delete(self, gone: DataFrame, **notes) -> KeyedTable:
        """The table without the keys of ``gone``."""

        def merge(old: DataFrame, new: DataFrame) -> DataFrame:
            return old.join(new.select(F.col(self.key).alias("__k")), F.col(self.key).eqNullSafe(F.col("__k")), "left_anti")

        return self.change(gone, merge, **notes)

    def vacuum(self) -> None:
        """Delete the files of versions before this one; nobody may be reading them."""
        versions.vacuum(self.spark, self.path, {f"{f}/{BUCKET}={b}" for b, f in self.about["files"].items()}, 2)


def _has_files(spark: SparkSession, folder: str) -> bool:
    p, fs = versions._path(spark, f"{folder}/{BUCKET}=*")
    return bool(fs.globStatus(p))
