"""Sets of word shingles and their Jaccard similarity: what confirms SimHash links and finds those out of their reach.

Words are those of ``simhash``; a text's set holds its distinct shingles of ``shingle`` words (fewer
words: all of them; none: the empty shingle), as XXH64 hashes, and sets are told apart by 128 bits
of XXH3 of them.  At a similarity of 0.8 two 64-bit fingerprints differ in some 10 bits and in up to 20, a
radius at which no tree of Hamming distances prunes anything, so pairs beyond the trees' radius
meet in bands: BANDS bands of ROWS minima; two sets of similarity s share one with probability
1 - (1 - s**ROWS)**BANDS, at 0.8 all but 3 in a million pairs.  Only what is similar enough by its
sets is linked, whichever way it met.

A band may hold a large group, and not all of its pairs are made into rows.  Each set is compared
with one leader of its band, and what is linked is joined.  After that, bands whose sets are still
in different components are cut into blocks of some ``BLOCK_BYTES`` of sets, and each two
blocks meet in one task, which compares all their sets by a matrix product (small bands share one); so a band of n blocks
sends each set n times, and no candidate pair is left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.components import components
from palimpsest.llm.shared import give_back, small, stored

SEED = 42
BANDS, ROWS = 24, 4
#: A block of a band is at most about so large; two of them meet in a task.
BLOCK_BYTES, BLOCK_SETS = 4 << 20, 4096
_rng = np.random.default_rng(11)
MULTIPLIERS = _rng.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
MIXERS = _rng.integers(0, 1 << 63, (BANDS, ROWS), np.uint64) * np.uint64(2) + np.uint64(1)


def bands(hashes: np.ndarray) -> np.ndarray:
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for lo in range(0, len(hashes), 1024):
        np.minimum(least, (hashes[None, lo : lo + 1024] * MULTIPLIERS[:, None]).min(1), out=least)
    return (least.reshape(BANDS, ROWS) * MIXERS).sum(1, dtype=np.uint64).view(np.int64)


def set_digest(hashes: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(hashes.tobytes(), SEED)


def alike(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    same = int((b[at] == a).sum())
    return same / (len(a) + len(b) - same)


def smallest(similarity: float) -> int:
    """Sets of fewer shingles are similar enough to equal ones only."""
    return next(n for n in range(1, 1 << 20) if n + 1e-9 >= similarity * (n + 1)) if similarity < 1 else 1 << 62


def _confirm(similarity: float):
    def run(batches):
        for b in small(batches):
            found = [alike(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)) + 1e-9 >= similarity for x, y in zip(b.column("x"), b.column("y"))]
            yield b.select(["a", "b"]).filter(pa.array(found, pa.bool_()))

    return run


def confirmed(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those of ``pairs`` (a, b) whose sets, from ``sets`` (id, hashes), are similar enough."""
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("hashes").alias("x")), "a").where(F.col("x").isNotNull())
    both = both.join(sets.select(F.col("id").alias("b"), F.col("hashes").alias("y")), "b").select("a", "b", "x", "y")
    return both.mapInArrow(_confirm(similarity), "a long, b long")


def _shared(owner: np.ndarray, column: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(owner, column, number) of shingles that two sets or more have, columns numbered anew."""
    twice = np.bincount(column)[column] > 1 if len(column) else np.zeros(0, bool)
    owner, column = owner[twice], column[twice]
    named, column = np.unique(column, return_inverse=True)
    return owner, column, len(named)


def links(sets: list[np.ndarray], roots: np.ndarray, similarity: float, width: int = 4096) -> np.ndarray:
    """Pairs (k, 2) of indexes of similar sets with different roots, enough to join what all such pairs join.

    Shingles in one set alone count in no intersection, and sets of which too few others are
    left have no partner.  Shingles in all sets count in every intersection.  The others make a matrix of zeros and ones,
    some columns at a time, whose product with itself is the size of each intersection; rows whose
    shared shingles are too few for any partner are passed over.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    every = np.concatenate([np.zeros(0, np.uint64), *sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    owner, column, columns = _shared(owner, np.unique(every, return_inverse=True)[1])
    able = np.arange(len(sets))
    while True:
        held = np.bincount(owner, minlength=len(able))
        stay = held + 1e-9 >= similarity * sizes[able]
        if stay.all() or not stay.any():
            able = able[stay]
            break
        place = np.cumsum(stay) - 1
        of = stay[owner]
        able, owner = able[stay], place[owner[of]]
        owner, column, columns = _shared(owner, column[of])
    n, out = len(able), []
    if n < 2:
        return np.zeros((0, 2), np.int64)
    sizes, root = sizes[able], np.unique(roots[able], return_inverse=True)[1]
    everywhere = np.bincount(column, minlength=columns) == n
    common = int(everywhere.sum())
    some = ~everywhere[column]
    owner, column = owner[some], column[some]
    column = np.unique(column, return_inverse=True)[1]
    columns -= common
    by_column = np.argsort(column, kind="stable")
    owner, column = owner[by_column], column[by_column]
    held = common + np.bincount(owner, minlength=n)
    step, width = max(1, min(n, (1 << 22) // n)), max(1, min(width, columns))
    for lo in range(0, n, step):
        most = min(held[lo : lo + step].max(), held.max())
        if most + 1e-9 < similarity * (sizes[lo : lo + step].min() + sizes.min() - most):
            continue
        same = np.full((min(step, n - lo), n), common, np.float32)
        for at in range(0, columns, width):
            some = slice(*np.searchsorted(column, [at, at + width]))
            m = np.zeros((n, width), np.float32)
            m[owner[some], column[some] - at] = 1
            same += m[lo : lo + step] @ m.T
        union = sizes[lo : lo + step, None] + sizes[None, :] - same
        near = (same + 1e-9 * union >= similarity * union) & (root[lo : lo + step, None] != root[None, :])
        a, b = np.nonzero(near)
        keep = np.flatnonzero(a + lo < b)
        if len(keep):
            # one pair for each two roots, and those two are one from here on
            pair = np.sort(np.stack([root[a[keep] + lo], root[b[keep]]], 1), axis=1)
            _, first = np.unique(pair, axis=0, return_index=True)
            for i in keep[first].tolist():
                x, y = int(a[i]) + lo, int(b[i])
                if root[x] != root[y]:
                    out.append((x, y))
                    root = np.where(root == max(root[x], root[y]), min(root[x], root[y]), root)
    return able[np.array(out, np.int64).reshape(-1, 2)]


def _blocks(similarity: float):
    def run(key, table):
        table = table.combine_chunks()
        ids, roots, of = (table.column(c).to_numpy() for c in ("id", "root", "band"))
        hashes = table.column("hashes").chunk(0)
        order = np.argsort(of, kind="stable")
        out = [np.zeros((0, 2), np.int64)]
        for at in np.split(order, np.flatnonzero(np.diff(of[order])) + 1):
            found = links([np.frombuffer(hashes[i].as_buffer(), np.uint64) for i in at.tolist()], roots[at], similarity)
            out.append(ids[at[found]])
        pairs = np.concatenate(out)
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

    return run


def _by_blocks(placed: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links within each band that still holds several components, found block by block; bands of one block share tasks."""
    size = placed.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.sum("n").alias("n"), F.count("*").alias("sets"))
    blocks = F.ceil(F.greatest(F.col("n") * 8 / BLOCK_BYTES, F.col("sets") / BLOCK_SETS)).cast("long")
    # of two sets one was the other's leader
    still = stored(size.where("low <> high AND sets > 2").select("band", "n", "sets", blocks.alias("blocks")), "still")
    small_ones = still.where("blocks = 1").agg(F.sum("n").alias("n"), F.sum("sets").alias("sets")).first()
    tasks = 1 + max((small_ones["n"] or 0) * 8 // BLOCK_BYTES, (small_ones["sets"] or 0) // BLOCK_SETS)
    own = F.pmod(F.xxhash64("id"), F.col("blocks"))
    some = placed.join(still.drop("n", "sets"), "band").select("band", "id", "root", "blocks", own.alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
    together = F.when(F.col("blocks") > 1, F.col("band")).otherwise(F.pmod("band", F.lit(tasks)))
    some = some.select("band", together.alias("task"), F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "id", "root")
    return some.join(sets, "id").groupBy("task", "i", "j").applyInArrow(_blocks(similarity), "a long, b long")


def linked_sets(members: DataFrame, sets: DataFrame, near: DataFrame, similarity: float) -> DataFrame | None:
    """(node, root) of all ids that links join; None if there are no links.

    ``members`` (band, id, n: sets' sizes, lead: an id of the band), ``sets`` (id, hashes) and ``near``
    (a, b), pairs that met before, are stored tables.
    """
    pairs = members.where("id <> lead").select(F.least("lead", "id").alias("a"), F.greatest("lead", "id").alias("b"))
    pairs = stored(pairs.unionByName(near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))).distinct(), "pairs")
    edges = stored(confirmed(pairs, sets, similarity), "found")
    roots = stored(components(edges), "roots")
    placed = members.select("band", "id", "n").join(roots.withColumnRenamed("node", "id"), "id", "left").select("band", "id", "n", F.coalesce("root", "id").alias("root"))
    more = stored(_by_blocks(stored(placed, "placed"), sets, similarity), "found")
    if not more.isEmpty():
        roots = stored(components(edges.unionByName(more)), "roots")
    return None if roots.isEmpty() else roots
