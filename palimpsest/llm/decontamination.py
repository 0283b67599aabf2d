"""Benchmark decontamination by word windows, in DataFrame functions alone.

Words are runs of digits, letters a to z and characters beyond ASCII, after A to Z are lower-cased.
A benchmark item gives each window of ``size`` consecutive words, or, if it has fewer, one window
of all its words.  A document's windows of the same lengths are first tested in their row against
a table of bits, hashed from three words of each benchmark window, with 1,024 bits or more for each
window (4 MB at most: beyond a million windows more of the others pass); the few that remain are joined, as whole strings, with the benchmark's
windows.  That side is broadcast only if its measured size is at most ``broadcast_bytes``; beyond
that Spark shuffles both sides, of which the documents' has only windows that passed the table.

Verdicts are of rows, which are told apart by their place in the files: rows of one doc_id, or of
none, are judged each by its own text.  Null and empty texts have no words; a long text's words are
held in memory at once.  Items without words have no window; a null item_id counts as the empty
string.  Repeated rows get a row each, equal item_ids count once; further columns are ignored (they
pass through ``keep_clean``); an empty table of documents gives an empty result, an empty benchmark
no hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.shared import FILE, ROW, ROW_KEY, read_table, stored, with_row_key, without_rows

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BETWEEN = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
LEAST_SLOTS, MOST_SLOTS, SLOTS_EACH = 1 << 15, 1 << 25, 1024


def words_of(text: Column) -> Column:
    """Array of a text's words."""
    low = F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.array_remove(F.split(F.coalesce(low, F.lit("")), BETWEEN), "")


def _hash(words: Column, at: Column, length: int) -> Column:
    """Hash of a window's length and its first, middle and last word."""
    picked = [F.get(words, at + k) for k in sorted({0, length // 2, length - 1})]
    return F.xxhash64(F.lit(length), *picked)


def benchmark_windows(benchmark: DataFrame, size: int = 10) -> DataFrame:
    """window, length, hash and the sorted item_ids of every distinct window."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), words_of(F.col("text")).alias("words")).where(F.size("words") > 0)
    words, at = F.col("words"), F.col("at")
    cut = items.select("item_id", "words", F.least(F.size("words"), F.lit(size)).alias("length"))
    cut = cut.select("*", F.explode(F.sequence(F.lit(0), F.size("words") - F.col("length"))).alias("at"))
    code = F.lit(0).cast("long")
    for n in range(1, size + 1):
        code = F.when(F.col("length") == n, _hash(words, at, n)).otherwise(code)
    rows = cut.select("item_id", "length", code.alias("hash"), F.array_join(F.slice("words", at + 1, F.col("length")), " ").alias("window"))
    return rows.groupBy("window").agg(F.first("length").alias("length"), F.first("hash").alias("hash"), F.sort_array(F.collect_set("item_id")).alias("items"))


def table_slots(n: int) -> int:
    """Bits of a table for ``n`` windows."""
    return min(MOST_SLOTS, max(LEAST_SLOTS, 1 << (SLOTS_EACH * n - 1).bit_length() if n else 0))


def taken(table: Column, code: Column, slots: int) -> Column:
    """Whether the bit of a hash's slot is set."""
    slot = F.pmod(code, F.lit(slots))
    return F.getbit(F.get(table, F.shiftright(slot, 6).cast("int")), slot.bitwiseAND(F.lit(63)).cast("int")) == 1


def bit_table(windows: DataFrame, slots: int) -> DataFrame:
    """One row, one column: an array of 64-bit numbers in which the bit of the slot of each of ``windows`` (hash) is set."""
    bits = windows.groupBy(F.expr(f"pmod(hash, {slots}) DIV 64").alias("id")).agg(F.bit_or(F.expr(f"shiftleft(1L, CAST(pmod(hash, {slots}) % 64 AS INT))")).alias("bits"))
    every = windows.sparkSession.range(slots // 64).join(bits, "id", "left").select("id", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"))
    return every.agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "bits"))), lambda x: x["bits"]).alias("bits"))


def _tried(docs: DataFrame, windows: DataFrame, size: int) -> tuple[DataFrame, int]:
    """Of ``docs`` with row keys: a row of length 0 for each, and one for each window that passes the table; bytes of ``windows``."""
    known = windows.groupBy("length").agg(F.count("*").alias("n"), F.sum(F.octet_length("window") + 64 + 24 * F.size("items")).alias("bytes")).collect()  # `size` rows at most
    n, words, at = sum(r["n"] for r in known), F.col("words"), F.col("at")
    slots = table_slots(n)
    rows = docs.select("doc_id", FILE, ROW, words_of(F.col("text")).alias("words"))
    # place -1 stands for the document itself
    rows = rows.select("*", F.explode(F.sequence(F.lit(-1), F.size("words") - 1)).alias("at"))
    passing = []
    if known:
        table = bit_table(windows, slots).scalar()
        for length in sorted(r["length"] for r in known):
            passing.append((length, (at >= 0) & (at + length <= F.size("words")) & taken(table, _hash(words, at, length), slots)))
    some = at == -1
    for _, ok in passing:
        some = some | ok
    # the windows' words become strings here, so that a row takes no array of words along
    of = lambda length: F.struct(F.lit(length).alias("length"), F.array_join(F.slice(words, at + 1, length), " ").alias("window"))
    none = F.array(F.struct(F.lit(0).alias("length"), F.lit(None).cast("string").alias("window")))
    # nulls go after the explosion: what would drop them here is not compiled, and rows would wait with their words
    found = F.when(at == -1, none).otherwise(F.array(*[F.when(ok, of(length)) for length, ok in passing]) if passing else none)
    rows = rows.where(some).select("doc_id", FILE, ROW, F.size("words").cast("long").alias("n_words"), "at", found.alias("found"))
    rows = rows.select("doc_id", FILE, ROW, "n_words", "at", F.explode("found").alias("w")).where("w IS NOT NULL")
    return rows.select("doc_id", FILE, ROW, "n_words", "at", "w.length", "w.window"), sum(r["bytes"] for r in known)


def _hits(docs: DataFrame, benchmark: DataFrame, size: int, broadcast_bytes: int) -> tuple[DataFrame, DataFrame]:
    """The documents' rows (doc_id, n_words) with their keys, and windows that occur (at, length, items) with the keys of their rows."""
    windows = stored(benchmark_windows(benchmark, size), "windows")
    tried, known_bytes = _tried(docs, windows, size)
    tried, known = stored(tried, "tried"), windows.select("window", "items")
    hits = tried.where("length > 0").join(F.broadcast(known) if known_bytes <= broadcast_bytes else known, "window")
    return tried.where("length = 0").select("doc_id", FILE, ROW, "n_words"), hits.select(FILE, ROW, "at", "length", "items")


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = 10, broadcast_bytes: int = 64 << 20) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated and the hit word spans of every row of ``docs`` (doc_id, text)."""
    rows, hits = _hits(with_row_key(docs), benchmark, size, broadcast_bytes)
    joined = hits.groupBy(*ROW_KEY).agg(
        F.sort_array(F.collect_list(F.struct("at", (F.col("at") + F.col("length")).alias("end")))).alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items")
    )
    joined = rows.join(joined, ROW_KEY, "left")
    none = F.array().cast("array<struct<at:int,end:int>>")
    joined = joined.select("doc_id", "n_words", F.coalesce("hits", none).alias("hits"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    covered = F.aggregate(
        "hits",
        F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
        lambda a, h: F.struct(F.greatest(a["end"], h["end"]).alias("end"), (a["n"] + F.greatest(F.lit(0), h["end"] - F.greatest(a["end"], h["at"]))).alias("n")),
        lambda a: a["n"],
    )
    return joined.select(
        "doc_id",
        "n_words",
        covered.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
        F.col("hits").alias("hit_spans"),
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame, size: int = 10, broadcast_bytes: int = 64 << 20) -> DataFrame:
    """The rows of ``docs``, all columns, of any names, without a hit in their own text."""
    keyed = with_row_key(docs)
    _, hits = _hits(keyed, benchmark, size, broadcast_bytes)
    return without_rows(keyed, stored(hits.select(*ROW_KEY).distinct(), "contaminated"), docs.columns)


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")).drop("hit_spans")


OP2_SQL = rf"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{BETWEEN}'), lambda x: x <> '') AS w FROM documents
), b AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{BETWEEN}'), lambda x: x <> '') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS gram
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM b WHERE len(w) > 0)
), sizes AS (
  SELECT DISTINCT n FROM bw
), dw AS (
  SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS gram
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)
), hit AS (
  SELECT doc_id, i, n, gram FROM dw SEMI JOIN bw USING (gram)
), words AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit JOIN bw USING (gram)) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""
