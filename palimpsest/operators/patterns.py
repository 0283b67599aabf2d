"""Many names or phrases at once: one Aho-Corasick automaton goes over each text.

The strings are few next to the texts, but nothing says how few: their bytes are counted first, and
where they are more than ``block_bytes`` they go in blocks by hash, each an automaton of bounded size with a
pass of its own.  A block is broadcast as strings and built once in each worker.  Texts are read in
Arrow batches and are never sent anywhere.

Null texts hold nothing; null and empty strings are left out; a text may be of any length.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from palimpsest.operators.graph import walk_steps
from palimpsest.plans.steps import importable

_built: dict[str, object] = {}
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def automaton(key: str, words: dict[str, object]):
    """An automaton over ``words``, built once in this process."""
    import ahocorasick

    if key not in _built:
        if len(_built) > 8:
            _built.clear()
        built = ahocorasick.Automaton()
        for w, value in words.items():
            built.add_word(w, value)
        built.make_automaton()
        _built[key] = built
    return _built[key]


def _blocks(words: DataFrame, block_bytes: int) -> Iterator[list]:
    """Distinct rows of ``words`` (word, ...) in blocks of some ``block_bytes``, one at a time on the driver."""
    words = words.where("word IS NOT NULL AND word <> ''").distinct()
    size = words.agg(F.coalesce(F.sum(F.octet_length("word") + 16), F.lit(0))).first()[0]
    n = max(1, -(-size // block_bytes))
    for i in range(n):
        rows = words.where(F.pmod(F.xxhash64("word"), F.lit(n)) == i).collect()
        if rows:
            yield rows


def found(texts: DataFrame, names: DataFrame, block_bytes: int = 16 << 20) -> DataFrame:
    """id, name: which of ``names`` (name) occur anywhere in ``texts`` (id, content), as ``contains`` on both as they are."""
    spark = texts.sparkSession
    importable(spark)
    whole, out = texts.select("id", "content"), None
    schema = StructType([whole.schema["id"], StructField("name", StringType())])
    for rows in _blocks(names.select(F.col("name").alias("word")), block_bytes):
        sent = spark.sparkContext.broadcast([r["word"] for r in rows])
        one = whole.mapInArrow(_finder(sent), schema)
        out = one if out is None else out.unionByName(one)
    return spark.createDataFrame([], schema) if out is None else out


def _finder(sent) -> Callable:
    def run(batches):
        words = sent.value
        if not words:
            return
        a = automaton(f"find-{len(words)}-{hash(tuple(words))}", {w: w for w in words})
        for b in batches:
            rows, names = [], []
            for i, text in enumerate(b.column("content").to_pylist()):
                hits = {w for _, w in a.iter(text)} if text else ()
                rows += [i] * len(hits)
                names += sorted(hits)
            yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(rows, pa.int64())), pa.array(names, pa.string())], ["id", "name"])

    return run


def replaced(texts: DataFrame, phrases: DataFrame, block_bytes: int = 16 << 20) -> DataFrame:
    """``texts`` (id, content) with the phrases of ``phrases`` (phrase, symbol) replaced, whatever the case of their ASCII letters.

    As if each phrase were replaced in turn, the longest first and of one length by name, where no
    phrase occurs in a symbol: longer phrases win places, then those on the left.  The phrases
    must fit one block, ValueError if they do not: what a place becomes depends on all of them.
    """
    spark = texts.sparkSession
    importable(spark)
    blocks = list(_blocks(phrases.select(F.translate("phrase", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("word"), "symbol").groupBy("word").agg(F.min("symbol").alias("symbol")), block_bytes))
    if len(blocks) > 1:
        raise ValueError(f"phrases of more than {block_bytes} bytes")
    if not blocks:
        return texts.select("id", "content")
    sent = spark.sparkContext.broadcast({r["word"]: r["symbol"] for r in blocks[0]})
    whole = texts.select("id", "content")
    return whole.mapInArrow(_replacer(sent), whole.schema)


def _replacer(sent) -> Callable:
    def run(batches):
        words = sent.value
        a = automaton(f"replace-{len(words)}-{hash(tuple(sorted(words.items())))}", {w: (len(w), w) for w in words})
        for b in batches:
            out = []
            for text in b.column("content").to_pylist():
                out.append(_with_symbols(text, a, words) if text else text)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(out, pa.string())], ["id", "content"])

    return run


def _with_symbols(text: str, a, words: dict[str, str]) -> str:
    hits = sorted((-n, w, end + 1 - n) for end, (n, w) in a.iter(text.translate(LOWER)))
    if not hits:
        return text
    taken, places = bytearray(len(text)), []
    for n, w, at in hits:
        if not any(taken[at : at - n]):
            taken[at : at - n] = b"\x01" * -n
            places.append((at, at - n, words[w]))
    pieces, last = [], 0
    for lo, hi, symbol in sorted(places):
        pieces += [text[last:lo], symbol]
        last = hi
    return "".join([*pieces, text[last:]])


def seeds(ents: DataFrame, queries: DataFrame, each: int = 2) -> DataFrame:
    """query_id, name: entities (name) named in each of ``queries`` (query_id, query), as ``graph.seeds`` has them for one.

    A query that names none has, for each of its words over three characters, the first two names that hold the
    word or that it holds.
    """
    low = queries.select("query_id", F.lower("query").alias("query"))
    names = ents.select("name").distinct()
    named = found(low.select(F.col("query_id").alias("id"), F.col("query").alias("content")), names).withColumnRenamed("id", "query_id")
    rest = low.join(named.select("query_id").distinct(), "query_id", "left_anti")
    words = rest.select("query_id", F.explode(F.array_distinct(F.split("query", r"\s+"))).alias("word")).where(F.length("word") > 3)
    distinct = words.select("word").distinct()
    held = found(distinct.select(F.col("word").alias("id"), F.col("word").alias("content")), names).withColumnRenamed("id", "word")
    holding = found(names.select(F.col("name").alias("id"), F.col("name").alias("content")), distinct.select(F.col("word").alias("name"))).select(F.col("name").alias("word"), F.col("id").alias("name"))
    place = F.row_number().over(Window.partitionBy("word").orderBy("name"))
    few = held.unionByName(holding).distinct().withColumn("n", place).where(F.col("n") <= each).select("word", "name")
    return named.unionByName(words.join(few, "word").select("query_id", "name").distinct())


def walks(start: DataFrame, rels: DataFrame, hops: int = 2, least: float = 0.5) -> DataFrame:
    """query_id, name, hop: ``graph.walk`` from each query's own ``start`` (query_id, name)."""
    return walk_steps(start, rels, hops, least, ["query_id"])
