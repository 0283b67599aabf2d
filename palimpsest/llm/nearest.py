"""Approximate nearest neighbours by collision counting.

Vectors go to unit length, where the nearest by Euclidean distance have the largest cosine.  Each of
``projections`` random lines gives a sorted array of a block's vectors.  A query opens a window
around its own place in each array; a vector in the window collides with it.  Windows widen with the
radius in turn (virtual rehashing: the arrays stay, the windows grow), and each step counts only what
came into them anew.  Vectors with collisions enough are verified by their exact cosine on
the original values.  A query ends in a block once its ``k``-th verified vector is within the radius:
a vector at the radius has collisions enough with a probability of 1 - ``miss`` or more, and a nearer one
with a larger one.

Vectors and queries meet block by block (``operators.grid``): every row is in the index, no block
or candidate is capped, and a task holds two blocks of bounded size.  Of rows with one vector the
k + 1 smallest ids are indexed, which are all that any answer can hold, since ties go to the smaller
id.  The first radius is the ``QUANTILE`` of what a bounded sample (``sample`` vectors, ``probes``
queries) needs; it only saves steps, for too large a radius costs time and no result.

Rows whose id or vector is null, or whose vector is empty, zero or has null or non-finite values,
take no part, as queries or as candidates; vectors meet vectors of their own length alone.  Repeated
rows (id and vector) count once; of rows with one id and different vectors each is a candidate, and
each that is a query gets its own rows; a query's id is never in its answer.  Queries with fewer
candidates than k get all there are.  Further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.llm.shared import read_table, stored
from palimpsest.operators.grid import in_cells

#: Half a window for each unit of radius: a vector at the radius is in it with a probability of 0.8.
HALF = 1.3
STEP, QUANTILE = 1.03, 0.1
#: Windows of so many arrays are counted at once, which keeps what is counted in a core's cache.
AT_ONCE = 8
FOUND = "query_id long, query_hash long, vec_id long, score double"


@functools.cache
def lines(dim: int, projections: int) -> np.ndarray:
    """Random lines, as columns: whole orthonormal bases one after another, so that counts scatter less than those of free lines."""
    rng = np.random.default_rng(20_011 + dim)
    bases = [np.linalg.qr(rng.standard_normal((dim, dim)))[0] for _ in range(-(-projections // dim))]
    return np.concatenate(bases, axis=1)[:, :projections] * math.sqrt(dim)


@functools.cache
def least_collisions(dim: int, projections: int, miss: float, draws: int = 20_000) -> int:
    """The most collisions that a vector at the radius, in a random direction, falls short of with a probability of at most ``miss``."""
    away = np.random.default_rng(40_013).standard_normal((draws, dim))
    away /= np.sqrt((away * away).sum(1))[:, None]
    return int(np.quantile((np.abs(away @ lines(dim, projections)) <= HALF).sum(1), miss, method="lower"))


def matrix(column) -> np.ndarray:
    """Rows of a list column of one length, scaled by a power of two so that squares stay finite."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    out = np.asarray(pc.list_flatten(column), np.float64).reshape(len(column), -1)
    return np.ldexp(out, -np.frexp(np.abs(out).max(1))[1][:, None])


class Index:
    """Sorted projections of a block of vectors."""

    def __init__(self, vectors: np.ndarray, projections: int = 64, miss: float = 0.01):
        self.vectors, self.norms = vectors, np.sqrt((vectors * vectors).sum(1))
        self.lines, self.least = lines(vectors.shape[1], projections), least_collisions(vectors.shape[1], projections, miss)
        at = (vectors / self.norms[:, None] @ self.lines).T
        self.order = np.argsort(at, axis=1)
        self.sorted = np.take_along_axis(at, self.order, 1)

    def cosines(self, query: np.ndarray, rows: np.ndarray) -> np.ndarray:
        return (self.vectors[rows] * query).sum(1) / (self.norms[rows] * np.sqrt((query * query).sum()))

    def search(self, query: np.ndarray, enough, radius: float) -> tuple[np.ndarray, np.ndarray, float]:
        """(rows verified, their cosines, the radius at the end) of one query.

        ``enough(rows, cosines, radius)`` says whether what was verified is an answer.
        """
        n, m = len(self.vectors), len(self.order)
        centre = query / np.sqrt((query * query).sum()) @ self.lines
        hits, seen = np.zeros(n, np.int64), np.zeros(n, bool)
        low = high = None
        rows, scores = np.zeros(0, np.int64), np.zeros(0)
        while True:
            # no two unit vectors are farther apart than 2; beyond that windows take everything in
            half = HALF * radius if radius <= 2 else np.inf
            lo = [int(s.searchsorted(c - half, "left")) for s, c in zip(self.sorted, centre)]
            hi = [int(s.searchsorted(c + half, "right")) for s, c in zip(self.sorted, centre)]
            if low is None:
                fresh = [self.order[j, lo[j] : hi[j]] for j in range(m)]
            else:
                fresh = [self.order[j, a:b] for j in range(m) for a, b in ((lo[j], low[j]), (high[j], hi[j])) if a < b]
            for j in range(0, len(fresh), AT_ONCE):
                hits += np.bincount(np.concatenate(fresh[j : j + AT_ONCE]), minlength=n)
            low, high = lo, hi
            new = np.flatnonzero((hits >= self.least) & ~seen)
            if len(new):
                seen[new] = True
                rows, scores = np.concatenate([rows, new]), np.concatenate([scores, self.cosines(query, new)])
            if radius > 2 or enough(rows, scores, radius):
                return rows, scores, radius
            radius *= STEP


def near(score, radius: float):
    """Whether unit vectors of this cosine are within ``radius``."""
    return 2 - 2 * score <= radius * radius


def _searcher(k: int, projections: int, miss: float, radius: float):
    def run(key, queries: pa.Table, vectors: pa.Table):
        if not len(queries) or not len(vectors):
            return pa.table({n: pa.array([], t) for n, t in (("query_id", pa.int64()), ("query_hash", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64()))})
        index = Index(matrix(vectors.column("embedding")), projections, miss)
        ids = vectors.column("ids").combine_chunks()
        starts, flat = np.asarray(ids.offsets), np.asarray(ids.values)
        held = np.diff(starts)
        out = []
        for q, own, mark in zip(matrix(queries.column("embedding")), queries.column("query_id").to_pylist(), queries.column("query_hash").to_pylist()):
            # one more than k, for a query's own id may be among what was verified
            rows, scores, _ = index.search(q, lambda r, s, reach: held[r[near(s, reach)]].sum() > k, radius)
            best = np.argsort(-scores, kind="stable")
            if len(best) > k + 1:
                best = best[scores[best] >= scores[best[k]]]
            found = sorted((-s, i) for r, s in zip(rows[best].tolist(), scores[best].tolist()) for i in flat[starts[r] : starts[r + 1]].tolist() if i != own)[:k]
            out += [(own, mark, i, -s) for s, i in found]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 4, (pa.int64(), pa.int64(), pa.int64(), pa.float64()))], ["query_id", "query_hash", "vec_id", "score"])

    return run


def usable(vectors: DataFrame) -> DataFrame:
    """Rows of ``vectors`` (vec_id, embedding) that take part."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where("vec_id IS NOT NULL AND embedding IS NOT NULL").where(finite & F.exists("embedding", lambda x: x != 0))


def first_radius(index: DataFrame, k: int, projections: int, miss: float, sample: int, probes: int) -> float:
    """The ``QUANTILE`` of the radii at which ``probes`` vectors of a sample of ``sample`` find k + 1 in it."""
    rows = index.select("embedding", F.size("embedding").alias("dim")).limit(sample).toArrow()
    if not len(rows):
        return 1.0
    dim = pc.mode(rows.column("dim"))[0]["mode"].as_py()
    some = matrix(rows.filter(pc.equal(rows.column("dim"), dim)).column("embedding"))
    part = Index(some, projections, miss)
    # from so near that copies are found at once, in the larger steps that a guess allows
    reach = [part.search(q, lambda r, s, at: near(s, at).sum() > k, 0.5)[2] for q in some[:: max(1, len(some) // probes)][:probes]]
    return float(np.quantile(reach, QUANTILE))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, projections: int = 64, miss: float = 0.01, sample: int = 8192, probes: int = 64) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found of ``vectors`` for each of ``queries`` (both vec_id, embedding)."""
    place = F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))
    few = usable(vectors).distinct().withColumn("n", place).where(F.col("n") <= k + 1)
    index = stored(few.groupBy("embedding").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")), "vectors").withColumn("dim", F.size("embedding"))
    asked = usable(queries).select(F.col("vec_id").alias("query_id"), "embedding", F.xxhash64("embedding").alias("query_hash"), F.size("embedding").alias("dim")).distinct()
    radius = first_radius(index, k, projections, miss, sample, probes)
    found = in_cells(asked, index, "dim", ["query_id", "embedding"], ["embedding"], _searcher(k, projections, miss, radius), FOUND, 512)
    rank = F.row_number().over(Window.partitionBy("query_id", "query_hash").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op11_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where("vec_id % 50 = 0"))
