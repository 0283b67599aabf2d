"""Paged JSON history as a data source, for batch reads and streams.

``spark.read.format("paged_history").option("path", folder).load()`` has a row for each item of the
pages: page, at, item, error; a page without items is one row of nulls.  A source of pages has numbers from 0; it ends at the first page that
is missing or holds fewer than ``page_size`` items.  A page that cannot be read or is no JSON list is one
row with its error, and the reading goes on.

Options: ``path``; ``page_size`` (50); ``pages_per_task`` (20), the range of pages that one task
fetches.  ``PagedHistory`` reads the files page-N.json of a folder; a subclass with another ``body`` fetches
pages from a service.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from palimpsest.plans.steps import importable

ITEMS = "page int, at int, item string, error string"


class Pages(InputPartition):
    """Pages from ``first`` to before ``end``."""

    def __init__(self, first: int, end: int):
        super().__init__((first, end))
        self.first, self.end = first, end


class PagedHistory(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged_history"

    def schema(self) -> str:
        return ITEMS

    def body(self, page: int) -> str | None:
        """A page's text; None if there is none of this number.  Other failures raise OSError."""
        from pyarrow import fs

        path = self.options["path"].rstrip("/")
        files, at = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))
        try:
            with files.open_input_stream(f"{at}/page-{page}.json", compression=None) as f:
                return f.read().decode("utf-8", "replace")
        except FileNotFoundError:
            return None

    def exists(self, page: int) -> bool:
        try:
            return self.body(page) is not None
        except OSError:
            return True

    def items(self, page: int) -> tuple[list[str] | None, str | None]:
        """(items as JSON, None), or (None, what is wrong)."""
        try:
            found = json.loads(self.body(page) or "")
        except OSError as e:
            return None, str(e)
        except ValueError:
            found = None
        if not isinstance(found, list):
            return None, "no JSON list"
        return [json.dumps(x, ensure_ascii=False, separators=(",", ":")) for x in found], None

    def number(self, option: str, default: int) -> int:
        return max(1, int(self.options.get(option, default)))

    def rows(self, pages: Pages) -> Iterator[tuple]:
        for page in range(pages.first, pages.end):
            items, error = self.items(page)
            if not items:  # a page without items has a row too, for it is the end
                yield page, 0, None, error
            for at, item in enumerate(items or ()):
                yield page, at, item, None

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(self)


class _Reader(DataSourceReader):
    def __init__(self, source: PagedHistory):
        self.source = source

    def pages(self) -> int:
        """Pages up to the first that is missing, found in steps that double and then halve."""
        step = 1
        while self.source.exists(step - 1):
            step *= 2
        low, high = step // 2, step - 1  # ``low`` pages are there, page ``high`` is not
        while low < high:
            middle = (low + high) // 2
            low, high = (middle + 1, high) if self.source.exists(middle) else (low, middle)
        return low

    def partitions(self) -> list[Pages]:
        n, each = self.pages(), self.source.number("pages_per_task", 20)
        return [Pages(at, min(at + each, n)) for at in range(0, n, each)] or [Pages(0, 0)]

    def read(self, partition: Pages) -> Iterator[tuple]:
        return self.source.rows(partition)


class _StreamReader(DataSourceStreamReader):
    """Offsets count pages; a stream stands still at the end until there are more pages, and for good behind a short one.

    Spark asks for the end without saying where a stream stands, so after a restart each page is
    looked at once more, one at a time, to find a short one.
    """

    def __init__(self, source: PagedHistory):
        self.source, self.known, self.over = source, 0, False

    def initialOffset(self) -> dict:
        return {"page": 0}

    def latestOffset(self) -> dict:
        while not self.over and self.source.exists(self.known):
            items, _ = self.source.items(self.known)
            self.over = items is not None and len(items) < self.source.number("page_size", 50)
            self.known += 1
        return {"page": self.known}

    def partitions(self, start: dict, end: dict) -> list[Pages]:
        each = self.source.number("pages_per_task", 20)
        return [Pages(at, min(at + each, end["page"])) for at in range(start["page"], end["page"], each)]

    def read(self, partition: Pages) -> Iterator[tuple]:
        return self.source.rows(partition)

    def commit(self, end: dict) -> None:
        pass


def register(spark: SparkSession, source: type[PagedHistory] = PagedHistory) -> None:
    """Make the format known to the session, and this package to its workers."""
    importable(spark)
    spark.dataSource.register(source)


def read_history(spark: SparkSession, path: str, page_size: int = 50, **options):
    """ITEMS up to the first page with fewer than ``page_size`` items, whatever files come after it."""
    from pyspark.sql import functions as F

    register(spark)
    items = spark.read.format("paged_history").option("path", path).options(**options).load()
    # what decides the end is one number
    counts = items.groupBy("page").agg(F.count("item").alias("n"), F.max("error").alias("error"))
    short = counts.where(F.col("error").isNull() & (F.col("n") < page_size)).agg(F.min("page").alias("short"))
    kept = items.join(F.broadcast(short), F.coalesce(F.col("page") <= F.col("short"), F.lit(True)))
    return kept.select(*items.columns).where("item IS NOT NULL OR error IS NOT NULL")
