"""SimHash near-duplicates through vantage-point trees.

Fingerprint: A to Z lower-cased, words ``[^\\x20\\x09-\\x0D]+``, shingles of three words joined by a
space (fewer words: all of them), each hashed by XXH64 with seed 42; a bit is 1 if it is set in
over half of the hashes, repeats included.  No words: fingerprint zero.

Fingerprints within ``radius`` bits are linked.  Equal ones count once.  A top tree of vantage
points, fitted on a bounded sample, parts the distinct fingerprints by their Hamming distance
from its points; every fingerprint lives in one leaf.  As a query it also visits each leaf that
its ball overlaps: by the triangle inequality, the near side of a point with median m if
d <= m + radius, the far side if d > m - radius.  Leaves over ``leaf`` rows go on within their
task as trees of their own, down to small blocks that are compared exhaustively.  A leaf returns
a spanning forest of its links, so a dense group gives n - 1 edges and not all its pairs; the
forests are joined by connected components, and a component's id is its least doc_id.

The tree's shape only decides where work is done: for any sample every pair within the radius
meets.

``keep_one`` keeps one row of each group of texts whose sets of shingles have a Jaccard similarity of
``similarity``: what the trees link within ``radius`` bits is confirmed by the sets, and pairs that
similar but farther apart, which no tree of 64-bit fingerprints can find without visiting all
leaves, meet as ``jaccard`` has it.

Null and empty texts have fingerprint zero and are linked like any other; repeated rows
get a row each; null doc_ids are left out of component ids; doc_ids are whole numbers; texts may be
of any length, their words are taken some at a time; further columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import re
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.components import components
from palimpsest.llm.jaccard import SEED, bands, linked_sets, set_digest, smallest
from palimpsest.llm.quality import slices
from palimpsest.llm.shared import FILE, ROW, ROW_KEY, bounded, give_back, read_table, small, stored, with_row_key, without_rows

WORDS = 1 << 16


def hashes(raw: bytes, shingle: int = 3):
    """XXH64 of a text's shingles, in order, from some words at a time."""
    low, digest = raw.lower(), xxhash.xxh64_intdigest
    words = low.split() if len(low) < 1 << 20 else (m[0] for m in re.finditer(rb"[^\x20\x09-\x0D]+", low))
    words = iter(words)
    run, first = list(islice(words, WORDS)), True
    while first or len(run) >= shingle:
        joined = b" ".join(run)
        if len(run) <= shingle:
            if run or not first:
                yield np.array([digest(joined, SEED)], np.uint64)
            return
        sizes = np.fromiter(map(len, run), np.int64, len(run))
        ends = np.cumsum(sizes + 1) - 1
        starts = (ends - sizes)[: len(run) - shingle + 1].tolist()
        yield np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :].tolist())], np.uint64)
        more = list(islice(words, WORDS))
        if not more:
            return
        run, first = run[len(run) - shingle + 1 :] + more, False


def _bits(parts) -> int:
    ones, n = np.zeros(64, np.int64), 0
    for h in parts:
        ones += np.unpackbits(h.astype(">u8").view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
        n += len(h)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprint(raw: bytes, shingle: int = 3) -> int:
    return _bits(hashes(raw, shingle))


def shingles(raw: bytes, size: int = 5) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles; of no words, that of the empty one."""
    parts = [np.unique(h) for h in hashes(raw, size)]
    if not parts:
        return np.array([xxhash.xxh64_intdigest(b"", SEED)], np.uint64)
    return parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))


def _fingerprints(shingle: int):
    def run(batches):
        give_back()
        for b in small(batches):
            docs, at = b.column("doc_id"), 0
            for raws in slices(b.column("text").to_pylist()):
                fps = np.array([fingerprint(r, shingle) for r in raws], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([docs.slice(at, len(raws)), pa.array(fps)], ["doc_id", "fp"])
                at += len(raws)

    return run


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return texts.mapInArrow(_fingerprints(shingle), "doc_id long, fp long")


def distance(a: np.ndarray, b) -> np.ndarray:
    return np.bitwise_count(a ^ b)


class VantageTree:
    """Vantage points and medians in heap order; leaves are the slots below the last level."""

    def __init__(self, sample: np.ndarray, depth: int, seed: int = 5):
        self.depth = depth
        self.points = np.zeros(1 << depth, np.uint64)
        self.medians = np.full(1 << depth, 32, np.int64)
        self._fit(sample, 1, np.random.default_rng(seed))

    def _fit(self, rows: np.ndarray, node: int, rng) -> None:
        if node >= 1 << self.depth:
            return
        # of a few candidates, the point whose distances spread most has the least overlap
        tried = rng.integers(0, 1 << 63, 4, np.uint64) * np.uint64(2) + rng.integers(0, 2, 4, np.uint64)
        if len(rows):
            tried[:3] = rng.choice(rows, 3)
            best = max(tried, key=lambda p: float(np.std(distance(rows, p).astype(np.float64))))
        else:
            best = tried[0]
        self.points[node] = best
        d = distance(rows, best).astype(np.int64)
        if len(rows):
            self.medians[node] = int(np.median(d))
        near = d <= self.medians[node]
        self._fit(rows[near], 2 * node, rng)
        self._fit(rows[~near], 2 * node + 1, rng)

    def visits(self, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, leaf, home): every leaf that each fingerprint's ball overlaps; home where it lives."""
        rows, nodes, home = np.arange(len(fps)), np.ones(len(fps), np.int64), np.ones(len(fps), bool)
        for _ in range(self.depth):
            d = distance(fps[rows], self.points[nodes]).astype(np.int64)
            m = self.medians[nodes]
            near = d <= m
            go_near, go_far = d <= m + radius, d > m - radius
            rows, nodes, home = (
                np.concatenate([rows[go_near], rows[go_far]]),
                np.concatenate([2 * nodes[go_near], 2 * nodes[go_far] + 1]),
                np.concatenate([(home & near)[go_near], (home & ~near)[go_far]]),
            )
        return rows, nodes - (1 << self.depth), home


def links(stored_fps: np.ndarray, queries: np.ndarray, radius: int, block: int = 512, depth: int = 0, seed: int = 9):
    """Pairs of indexes (stored, query) within the radius, in pieces, by a tree with triangle bounds."""
    if not len(stored_fps) or not len(queries):
        return
    if len(stored_fps) <= block or depth >= 24:
        step = max(1, (1 << 20) // min(len(stored_fps), 1 << 20))
        for lo in range(0, len(queries), step):
            for at in range(0, len(stored_fps), 1 << 20):
                q, s = np.nonzero(distance(queries[lo : lo + step, None], stored_fps[None, at : at + (1 << 20)]) <= radius)
                if len(q):
                    yield s + at, q + lo
        return
    rng = np.random.default_rng(seed + depth)
    best = max(rng.choice(stored_fps, 3), key=lambda p: float(np.std(distance(stored_fps, p).astype(np.float64))))
    ds, dq = distance(stored_fps, best).astype(np.int64), distance(queries, best).astype(np.int64)
    m = int(np.median(ds))
    if (ds <= m).all():
        m = int(ds.max()) - 1
    for s_at, q_at in ((np.flatnonzero(ds <= m), np.flatnonzero(dq <= m + radius)), (np.flatnonzero(ds > m), np.flatnonzero(dq > m - radius))):
        whole = len(s_at) == len(stored_fps)
        for s, q in links(stored_fps[s_at], queries[q_at], radius, block, 24 if whole else depth + 1, seed):
            yield s_at[s], q_at[q]


def spanning_forest(n: int, pairs) -> np.ndarray:
    """Edges (k, 2) that join what ``pairs``, pieces of index arrays below n, join."""
    root, out = np.arange(n), []
    for a, b in pairs:
        a, b = root[a], root[b]
        apart = a != b
        if not apart.any():
            continue
        keys = np.unique(np.minimum(a, b)[apart] * n + np.maximum(a, b)[apart])
        up: dict[int, int] = {}
        for low, high in zip((keys // n).tolist(), (keys % n).tolist()):
            while low in up:
                low = up[low]
            while high in up:
                high = up[high]
            if low != high:
                low, high = min(low, high), max(low, high)
                up[high] = low
                out.append((low, high))
        root[list(up)] = list(up.values())
        while (nxt := root[root]).tobytes() != root.tobytes():
            root = nxt
    return np.array(out, np.int64).reshape(-1, 2)


def _leaf(radius: int):
    def run(key, table):
        asks = table.column("fp").to_numpy().view(np.uint64)
        order = np.argsort(asks)
        asks = asks[order]
        at_home = np.flatnonzero(table.column("home").to_numpy(zero_copy_only=False)[order])
        edges = spanning_forest(len(asks), ((at_home[s], q) for s, q in links(asks[at_home], asks, radius)))
        found = asks[edges].view(np.int64)
        return pa.table({"a": found[:, 0], "b": found[:, 1]})

    return run


def _router(tree, radius: int):
    def run(batches):
        t = tree.value
        for b in batches:
            fps = b.column("fp").to_numpy().view(np.uint64)
            for lo in range(0, len(fps), 4096):
                part = fps[lo : lo + 4096]
                rows, leaf, home = t.visits(part, radius)
                yield pa.RecordBatch.from_arrays([pa.array(leaf.astype(np.int32)), pa.array(part[rows].view(np.int64)), pa.array(home)], ["leaf", "fp", "home"])

    return run


def fingerprint_links(fps: DataFrame, radius: int, leaf: int = 4096, sample: int = 1 << 15) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs of distinct ``fps`` (fp) within the radius."""
    spark = fps.sparkSession
    n = fps.count()
    depth = max(0, min(16, (max(n, 1) // leaf).bit_length()))
    # vantage points come from at most `sample` fingerprints, those of least hash, of which each task
    # offers its share; every fingerprint is placed and asked
    share = min(1 << 30, -(-(1 << 30) * 2 * sample // max(n, 1)))
    some = fps.where(F.pmod(F.xxhash64("fp"), F.lit(1 << 30)) < share).orderBy(F.xxhash64("fp")).limit(sample).toPandas()["fp"].to_numpy(np.int64).view(np.uint64)
    tree = spark.sparkContext.broadcast(VantageTree(np.sort(some), depth))
    return fps.mapInArrow(_router(tree, radius), "leaf int, fp long, home boolean").groupBy("leaf").applyInArrow(_leaf(radius), "a long, b long")


def near_duplicates(docs: DataFrame, radius: int = 2, shingle: int = 3) -> DataFrame:
    """doc_id, fingerprint, component_id of every row of ``docs`` (doc_id, text)."""
    marked = stored(fingerprints(docs, shingle), "fingerprints")
    owners = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "owners")
    edges = fingerprint_links(owners.select("fp"), radius)
    roots = components(edges)
    # written, so that each side of a join is an exchange of its own and Spark can split a hot key
    linked = stored(owners.join(roots, owners["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root")), "linked")
    least = stored(linked.groupBy("root").agg(F.min("first").alias("component_id")), "least")
    placed = linked.join(least, "root").select("fp", "component_id")
    return marked.join(placed, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _mark(shingle: int, similarity: float, empty: pa.Schema):
    least = smallest(similarity)

    def run(batches):
        give_back()
        for b in small(batches):
            keys, at = b.select(["doc_id", FILE, ROW]), 0
            for raws in slices(b.column("text").to_pylist()):
                part = keys.slice(at, len(raws))
                at += len(raws)
                ids, fps, sizes, cut = [], [], [], []
                for raw in raws:
                    own = list(hashes(raw, shingle))
                    fps.append(_bits(own))
                    s = np.unique(np.concatenate(own)) if own else shingles(b"", shingle)
                    ids.append(set_digest(s))
                    sizes.append(len(s))
                    cut.append(bands(s) if len(s) >= least else None)
                long = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(ids, pa.binary()), long(fps), pa.array(sizes, pa.int64()), pa.array(cut, pa.list_(pa.int64()))], empty.names)

    return run


def _sets(shingle: int):
    def run(batches):
        give_back()
        for b in small(batches):
            at = 0
            for raws in slices(b.column("text").to_pylist()):
                yield pa.RecordBatch.from_arrays([b.column("id").slice(at, len(raws)), pa.array([shingles(r, shingle).tobytes() for r in raws], pa.binary())], ["id", "hashes"])
                at += len(raws)

    return run


def _near_fingerprints(owners: DataFrame, radius: int) -> DataFrame:
    """Pairs (a, b) of set ids that join all whose fingerprints the trees join."""
    first = stored(owners.groupBy("fp").agg(F.min("id").alias("a"), F.count("*").alias("n")), "first")
    equal = owners.join(first.where("n > 1").drop("n"), "fp").where("id <> a").select("a", F.col("id").alias("b"))
    near = stored(fingerprint_links(first.select("fp"), radius), "fingerprint-links")
    near = near.join(first.select(F.col("fp").alias("a"), F.col("a").alias("x")), "a").select("x", "b")
    near = near.join(first.select(F.col("fp").alias("b"), F.col("a").alias("y")), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    return equal.unionByName(near)


def copies(docs: DataFrame, similarity: float = 0.8, shingle: int = 5, radius: int = 3) -> tuple[DataFrame, DataFrame]:
    """``docs`` (doc_id, text) with row keys, and the keys of all rows but one of each group of near-duplicates.

    The row that stays has the least doc_id (null: after all others), then the least
    fingerprint, then the first place in the files.
    """
    keyed = with_row_key(docs)
    texts = keyed.select("doc_id", FILE, ROW, F.coalesce("text", F.lit("")).alias("text"))
    kind = dict(docs.dtypes)["doc_id"]
    names = pa.schema([(n, pa.null()) for n in ("doc_id", FILE, ROW, "digest", "fp", "n", "bands")])
    marked = stored(texts.mapInArrow(_mark(shingle, similarity, names), f"doc_id {kind}, {FILE} long, {ROW} long, digest binary, fp long, n long, bands array<long>"), "marked")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "fp", FILE, ROW)
    owners = marked.groupBy("digest").agg(F.min(order).alias("first"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    # numbers, once they are written, are those of the one attempt whose rows count
    owners = stored(owners.select(F.monotonically_increasing_id().alias("id"), "first", "first.fp", "n", "bands"), "owners")

    members = stored(owners.select("id", "n", F.explode("bands").alias("band")), "members")
    many = stored(members.groupBy("band").agg(F.count("*").alias("sets"), F.min("id").alias("lead")).where("sets > 1").select("band", "lead"), "many")
    members = stored(members.join(bounded(many), "band"), "members")
    near = stored(_near_fingerprints(owners.select("id", "fp"), radius), "near")
    met = members.select("id").unionByName(near.select(F.explode(F.array("a", "b")).alias("id"))).distinct()
    rows = stored(owners.join(met, "id").select("id", F.col(f"first.{FILE}").alias(FILE), F.col(f"first.{ROW}").alias(ROW)), "candidates")
    sets = stored(texts.join(bounded(rows), ROW_KEY).select("id", "text").mapInArrow(_sets(shingle), "id long, hashes binary"), "sets")
    roots = linked_sets(members, sets, near, similarity)
    best = owners.select("id", "first") if roots is None else owners.join(roots.withColumnRenamed("node", "id"), "id", "left").select(F.coalesce("root", "id").alias("id"), "first")
    best = stored(best.groupBy("id").agg(F.min("first").alias("first")).select(f"first.{FILE}", f"first.{ROW}"), "best")
    return keyed, stored(marked.select(*ROW_KEY).join(best, ROW_KEY, "left_anti"), "copies")


def keep_one(docs: DataFrame, similarity: float = 0.8, shingle: int = 5, radius: int = 3) -> DataFrame:
    """One row, all columns, of each group of near-duplicates in ``docs`` (doc_id, text), as ``copies`` has it.

    Rows without a doc_id count like any other; repeated rows leave one; texts without words are
    one group; an empty table stays empty; further columns of any name pass through.
    """
    return without_rows(*copies(docs, similarity, shingle, radius), docs.columns)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))
