"""What each filter of a chain removes, in every order of the chain.

A document's incidence is a mask with a bit for each filter that it fails.  Whatever happens to it in
an order of the filters follows from the mask alone: the first filter of the order that it fails
removes it.  So each part of a corpus comes down to histograms over the 2^f masks, of all documents and
of the labelled ones, stacked as the rows of a matrix.  Times an integer matrix with a row for each
mask and a column for each (order, step) (for five filters 32 by 600), they give what every step keeps,
removes, finds removed already and alone would find, for all orders at once.

Null text is empty; a null part is the empty string.  A document without doc_id is never a copy of
another, and no other is a copy of it; labels without doc_id count for nothing.  A doc_id with several
labels has a label if one of them is 1.  Repeated rows count each; they are no copies of each
other, for neither id is smaller.  Texts may be of any length that a row holds.  Further columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.shared import read_table, stored

SPACE = r"[\x20\x09-\x0D]+"
FILTERS = "ABCDE"
COUNTS = ["n", "good", "toxic"]
AUDIT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def text_filters(text: Column) -> dict[str, Column]:
    """Failure conditions of filters A to D on a text that is not null."""
    words = F.array_remove(F.split(text, SPACE), "")
    return {
        "A": F.size(words) < 50,
        "B": 100 * F.size(F.array_distinct(words)) < 65 * F.size(words),
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > 5 * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }


@functools.cache
def outcome_matrices(filters: str) -> dict[str, np.ndarray]:
    """Masks by (order, step): 1 where a document of the mask has the outcome there; ``shapley`` is ``removed`` of the step's filter, summed over all orders."""
    f = len(filters)
    orders = list(itertools.permutations(range(f)))
    fails = (np.arange(1 << f)[:, None] >> np.arange(f)) & 1
    at = np.array(orders).ravel()
    failing = fails[:, at].reshape(1 << f, len(orders), f)  # in the order's own sequence
    before = np.cumsum(failing, axis=2) - failing
    removed = failing * (before == 0)
    kept = (np.cumsum(failing, axis=2) == 0).astype(np.int64)
    alone = failing * (fails.sum(1) == 1)[:, None, None]
    out = {"kept": kept, "removed": removed, "redundant": failing * (before > 0), "unique_fails": alone}
    flat = {k: v.reshape(1 << f, -1).astype(np.int64) for k, v in out.items()}
    by_filter = np.stack([flat["removed"][:, at == i].sum(1) for i in range(f)], axis=1)
    return flat | {"shapley": by_filter[:, at]}


def _audit(filters: str):
    def run(batches):
        m = outcome_matrices(filters)
        orders = ["".join(p) for p in itertools.permutations(filters)]
        steps, columns = len(filters), len(orders) * len(filters)
        names, places = np.repeat(orders, steps).tolist(), np.tile(np.arange(1, steps + 1, dtype=np.int32), len(orders))
        for b in batches:
            for part, masks in zip(b.column("part").to_pylist(), b.column("masks").to_pylist()):
                rows = np.zeros((len(COUNTS), 1 << steps), np.int64)
                for x in masks:
                    rows[:, x["mask"]] = [x[c] for c in COUNTS]
                every, good, toxic = rows
                made = [every @ m[k] for k in ("kept", "removed", "redundant", "unique_fails")] + [good @ m["removed"], toxic @ m["removed"], every @ m["shapley"]]
                yield pa.RecordBatch.from_arrays([pa.array([part] * columns), pa.array(names), pa.array(places), *map(pa.array, made)], [c.split()[0] for c in AUDIT.split(", ")])

    return run


def audit(masks: DataFrame, filters: str) -> DataFrame:
    """AUDIT rows from ``masks`` (part, mask, good, toxic), a row for each document; bit i of ``mask`` is filter i of ``filters``."""
    if not 1 <= len(filters) <= 6 or len(set(filters)) < len(filters):
        raise ValueError("one to six filters, each by a letter of its own")
    ones = lambda c: F.sum(F.col(c).cast("long")).alias(c)
    cells = masks.groupBy("part", "mask").agg(F.count("*").alias("n"), ones("good"), ones("toxic"))
    # 2^f masks at most for each part
    histograms = cells.groupBy("part").agg(F.collect_list(F.struct("mask", *COUNTS)).alias("masks"))
    return histograms.mapInArrow(_audit(filters), AUDIT)


def document_masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, part, mask, good, toxic of every row of ``docs`` (doc_id, text, source); ``labels``: doc_id, quality, toxic."""
    text = F.coalesce("text", F.lit(""))
    # E is the bit of all but the first of each text: found without sending texts, and without bringing a text's copies together
    bits = [F.when(c, 1 << i).otherwise(0) for i, c in enumerate(text_filters(F.col("text")).values())]
    texts = docs.select("doc_id", text.alias("text"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"))
    rows = stored(texts.select("doc_id", "part", functools.reduce(lambda a, b: a + b, bits).alias("mask"), F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("content")), "incidence")
    first = rows.groupBy("content").agg(F.min("doc_id").alias("doc_id")).where("doc_id IS NOT NULL").withColumn("first", F.lit(True))
    marks = labels.groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    known = rows.join(first, ["content", "doc_id"], "left").join(marks, "doc_id", "left")
    copy = F.col("doc_id").isNotNull() & F.col("first").isNull()
    yes = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    return known.select("doc_id", "part", (F.col("mask") + F.when(copy, 16).otherwise(0)).alias("mask"), yes("good"), yes("toxic"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(document_masks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")), FILTERS)


OP12_SQL = """WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '') AS part FROM documents
), w AS (
  SELECT *, list_filter(string_split_regex(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words FROM t
), firsts AS (SELECT text, min(doc_id) AS first FROM t GROUP BY text
), marks AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id
), masks AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, {
      'A': len(words) < 50, 'B': 100 * len(list_distinct(words)) < 65 * len(words), 'C': 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text),
      'D': regexp_matches(text, '[#$%&*|]'), 'E': coalesce(doc_id > first, false)} AS f
  FROM w JOIN firsts USING (text) LEFT JOIN marks USING (doc_id)
), cells AS (
  SELECT part, f, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic, CAST(f.A AS INT) + CAST(f.B AS INT) + CAST(f.C AS INT) + CAST(f.D AS INT) + CAST(f.E AS INT) AS failed
  FROM masks GROUP BY part, f
), letters(x) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')
), orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS o FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), failing AS (
  SELECT part, n, good, toxic, failed, o, step, CASE substr(o, step, 1) WHEN 'A' THEN f.A WHEN 'B' THEN f.B WHEN 'C' THEN f.C WHEN 'D' THEN f.D ELSE f.E END AS fails, f
  FROM cells, orders, (SELECT unnest(range(1, 6)) AS step)
), before AS (
  SELECT *, coalesce(bool_or(fails) OVER (PARTITION BY part, f, o ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS gone FROM failing
), steps AS (
  SELECT part, o AS filter_order, CAST(step AS INTEGER) AS step, CAST(coalesce(sum(n) FILTER (NOT gone AND NOT fails), 0) AS BIGINT) AS kept, CAST(coalesce(sum(n) FILTER (NOT gone AND fails), 0) AS BIGINT) AS removed,
         CAST(coalesce(sum(n) FILTER (gone AND fails), 0) AS BIGINT) AS redundant, CAST(coalesce(sum(n) FILTER (fails AND failed = 1), 0) AS BIGINT) AS unique_fails,
         CAST(coalesce(sum(good) FILTER (NOT gone AND fails), 0) AS BIGINT) AS good_lost, CAST(coalesce(sum(toxic) FILTER (NOT gone AND fails), 0) AS BIGINT) AS toxic_lost
  FROM before GROUP BY part, o, step)
SELECT *, CAST(sum(removed) OVER (PARTITION BY part, substr(filter_order, step, 1)) AS BIGINT) AS shapley FROM steps"""
