"""Two tables in blocks, each pair of blocks a cell that one task works on."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CELL = ["__kind", "__left", "__right"]


def _blocks(df: DataFrame, kind: str, rows: int, values: int, name: str) -> DataFrame:
    """kind, number of blocks of at most ``rows`` rows, fewer where rows have many values."""
    most = F.greatest(F.lit(1), F.least(F.lit(rows), F.floor(F.lit(values) / F.greatest(F.col("__kind"), F.lit(1)))))
    return df.groupBy(F.col(kind).alias("__kind")).agg(F.count("*").alias("n")).select("__kind", F.ceil(F.col("n") / most).cast("int").alias(name))


def in_cells(left: DataFrame, right: DataFrame, kind: str, by_left: list[str], by_right: list[str], run: Callable, schema: str, left_rows: int = 4096, right_rows: int = 16384, values: int = 2 << 20) -> DataFrame:
    """What ``run(key, left rows, right rows)``, over Arrow tables, gives for each pair of blocks of two tables.

    Rows meet only rows of their own ``kind``, an integer column: the number of values that a row has.
    A block holds at most about ``left_rows`` or ``right_rows`` rows and ``values`` values, so a
    task's memory does not grow with the tables.  Rows are dealt to blocks by hashes of ``by_left``
    and ``by_right``, which should tell rows apart.  Every row is sent once for each block of the other
    side; nothing but the numbers of blocks comes to the driver.
    """
    n_left, n_right = _blocks(left, kind, left_rows, values, "n_left"), _blocks(right, kind, right_rows, values, "n_right")
    plan = n_left.join(n_right, "__kind")
    cells = plan.agg(F.sum(F.col("n_left").cast("long") * F.col("n_right"))).first()[0] or 1
    at = lambda by, n: F.pmod(F.xxhash64(*by), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    # a row for each length of rows: never many, but their number is the table's own
    one = left.withColumn("__kind", F.col(kind)).join(plan, "__kind").withColumns({"__left": at(by_left, "n_left"), "__right": each("n_right")}).drop("n_left", "n_right")
    other = right.withColumn("__kind", F.col(kind)).join(plan, "__kind").withColumns({"__right": at(by_right, "n_right"), "__left": each("n_left")}).drop("n_left", "n_right")
    # a number of partitions, for cells are small in bytes and long in time, and would be joined
    parts = min(2 * cells, 20_000)
    return one.repartition(parts, *CELL).groupBy(*CELL).cogroup(other.repartition(parts, *CELL).groupBy(*CELL)).applyInArrow(run, schema)
