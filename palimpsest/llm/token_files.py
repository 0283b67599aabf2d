"""Flat token-id files with 64-bit document offsets.

A store is a folder.  Part p, in ascending doc_id order over all parts, has three files:

* ``ids-p.bin``      ids as flat little-endian unsigned integers, 16 bits wide if all ids fit, else 32
* ``offsets-p.bin``  n + 1 unsigned 64-bit offsets into them, from 0
* ``docs-p.bin``     n signed 64-bit doc_ids; null ones come first, as 0

``parts`` (Parquet) lists part, documents, those without a doc_id, ids and ``base``, the ids of all
earlier parts, from a prefix sum.  Readers, one task for each part, map the files into memory where
the file system is local.

Null text is empty, a null doc_id comes first; every document has its end id.  doc_ids are whole
numbers.  Texts may be of any length that a row holds; their ids are in memory one at a time.
Repeated rows are stored once each; further columns are ignored; an empty table gives a store
without parts.
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
from palimpsest.llm.shared import filesystem, give_back, read_table, shared_path, small, write_bytes

WRITTEN = "part int, n_docs long, n_null long, n_ids long, width int"
PARTS = WRITTEN + ", base long"
ROWS = "doc_id long, start long, n_tokens long, ids_crc32 long"


def _writer(path: str, end_id: int, folder: str):
    def write(batches):
        e = encoder(path)
        dtype = e.dtype if end_id < 1 << 8 * e.dtype.itemsize else np.dtype("<u4")
        end, part = np.array([end_id], dtype).tobytes(), TaskContext.get().partitionId()
        docs, sizes, nulls = [], [], 0
        found = False

        def ids():
            nonlocal found, nulls
            for b in small(batches):
                of, texts = b.column("doc_id").to_pylist(), b.column("text").to_pylist()
                for lo in range(0, len(texts), 500):
                    raw = e.encode(texts[lo : lo + 500])
                    if dtype != e.dtype:
                        raw = [np.frombuffer(x, e.dtype).astype(dtype).tobytes() for x in raw]
                    docs.append(np.array([d or 0 for d in of[lo : lo + 500]], "<i8"))
                    nulls += of[lo : lo + 500].count(None)
                    sizes.append(np.array([len(x) // dtype.itemsize + 1 for x in raw], "<u8"))
                    found = True
                    yield end.join([*raw, b""])

        write_bytes(f"{folder}/ids-{part:06d}.bin", ids())
        give_back(encoders=False)
        if found:
            offsets = np.concatenate([np.zeros(1, "<u8"), np.cumsum(np.concatenate(sizes), dtype="<u8")])
            write_bytes(f"{folder}/offsets-{part:06d}.bin", [offsets.tobytes()])
            write_bytes(f"{folder}/docs-{part:06d}.bin", [np.concatenate(docs).tobytes()])
            row = {"part": part, "n_docs": len(offsets) - 1, "n_null": nulls, "n_ids": int(offsets[-1]), "width": dtype.itemsize}
            yield pa.RecordBatch.from_pylist([row], pa.schema([(k, pa.int32() if k in ("part", "width") else pa.int64()) for k in row]))

    return write


def write_store(docs: DataFrame, tokenizer_path: str, end_id: int, folder: str) -> None:
    """Encode ``docs`` (doc_id, text) into a store at ``folder``, a path that driver and executors share."""
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    ordered = texts.repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    parts = ordered.mapInArrow(_writer(tokenizer_path, end_id, folder), WRITTEN)
    # one row for each partition; the prefix sum over them gives each its base
    found, base, rows = sorted(parts.collect()), 0, []
    for r in found:
        rows.append((*r, base))
        base += r["n_ids"]
    docs.sparkSession.createDataFrame(rows, PARTS).coalesce(1).write.mode("overwrite").parquet(f"{folder}/parts")


def mapped(path: str, dtype):
    """A file's numbers: memory-mapped from a local file system, else read."""
    files, at = filesystem(path)
    if files.type_name == "local":
        return np.memmap(at, dtype, "r") if files.get_file_info(at).size else np.zeros(0, dtype)
    with files.open_input_file(at) as f:
        return np.frombuffer(f.read(), dtype)


def _reader(folder: str):
    def read(batches):
        for b in batches:
            for r in b.to_pylist():
                name = f"{r['part']:06d}.bin"
                ids = mapped(f"{folder}/ids-{name}", f"<u{r['width']}")
                offsets, docs = mapped(f"{folder}/offsets-{name}", "<u8"), mapped(f"{folder}/docs-{name}", "<i8")
                for lo in range(0, len(docs), 10_000):
                    at = offsets[lo : lo + 10_001].astype(np.int64)
                    crcs = [zlib.crc32(ids[x:y].astype("<u4").tobytes()) for x, y in zip(at[:-1].tolist(), at[1:].tolist())]
                    some = docs[lo : lo + 10_000]
                    null = np.arange(lo, lo + len(some)) < r["n_null"]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(some, mask=null), pa.array(at[:-1] + r["base"]), pa.array(np.diff(at)), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"]
                    )

    return read


def read_store(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from a store's files."""
    parts = spark.read.schema(PARTS).parquet(f"{folder}/parts")
    # a number of partitions, so that tasks are not joined for the few bytes that a part's row has
    return parts.repartitionByRange(max(1, parts.count()), "part").mapInArrow(_reader(folder), ROWS)


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_path(spark, "token-store")
    write_store(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 2, folder)
    return read_store(spark, folder)
