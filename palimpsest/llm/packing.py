"""Packing by power-of-two decomposition.

A document of L ids becomes ``L // most`` pieces of ``most`` ids and one piece for each bit of
the rest, longest first.  Pieces of equal length form a bucket; each piece is a sequence of its
own, whose length is a power of two, so nothing is padded and no sequence crosses documents.
Sequences are numbered without gaps, longest bucket first, from prefix sums over partitions.

Null text is empty; the end id makes every document at least one id long.  Repeated rows are
packed once each, in the order in which tasks meet them, as ties in length are; a text of any length
that a row holds is encoded whole; doc_ids are whole numbers; further columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.chunks import encoder
from palimpsest.llm.shared import give_back, read_table, small, stored

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part int, rank long"


def piece_lengths(n: int, most: int) -> list[int]:
    """Binary-length pieces of n ids, longest first."""
    rest = n % most
    return [most] * (n // most) + [1 << b for b in range(most.bit_length() - 1, -1, -1) if rest >> b & 1]


def _cutter(path: str, end_id: int, most: int):
    def cut(batches):
        e = encoder(path)
        part, seen = TaskContext.get().partitionId(), {}
        last = np.array([end_id], "<u4")
        for b in small(batches):
            ids_of, texts = b.column("doc_id").to_pylist(), b.column("text").to_pylist()
            for lo in range(0, len(texts), 500):
                rows: list[list] = [[] for _ in range(6)]
                for doc, raw in zip(ids_of[lo : lo + 500], e.encode(texts[lo : lo + 500])):
                    ids = memoryview(np.concatenate([np.frombuffer(raw, e.dtype).astype("<u4"), last]).tobytes())
                    n, start = len(ids) // 4, 0
                    for length in piece_lengths(n, most):
                        rank = seen.get(length, 0)
                        seen[length] = rank + 1
                        for column, v in zip(rows, (doc, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), n, rank)):
                            column.append(v)
                        start += length
                arrays = [pa.array(c, pa.int64()) for c in rows]
                parts = pa.array(np.full(len(rows[0]), part, np.int32))
                yield pa.RecordBatch.from_arrays([*arrays[:5], parts, arrays[5]], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "rank"])
        give_back(encoders=False)

    return cut


def pack_powers_of_two(docs: DataFrame, tokenizer_path: str, end_id: int = 1, most: int = 2048) -> DataFrame:
    """Pieces of every row of ``docs`` (doc_id, text): doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    if most & (most - 1):
        raise ValueError("the longest piece must be a power of two")
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    pieces = stored(texts.mapInArrow(_cutter(tokenizer_path, end_id, most), PIECES), "pieces")
    counts = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    # one row for each length, so log2(most) + 1 at most
    totals = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    first, base = [], 0
    for length in sorted(totals, reverse=True):
        first.append((F.col("length") == length, base))
        base += totals[length]
    start = F.lit(0).cast("long")
    for same, at in first:
        start = F.when(same, F.lit(at).cast("long")).otherwise(start)
    earlier = F.expr("sum(n) OVER (PARTITION BY length ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)") - F.col("n")
    bases = counts.select("length", "part", (earlier + start).alias("base"))
    return pieces.join(bases, ["length", "part"]).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("base") + F.col("rank")).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )


def op5_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_powers_of_two(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
