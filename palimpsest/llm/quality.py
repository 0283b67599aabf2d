"""Text statistics and labelled training rows that the two quality models share."""

from __future__ import annotations

import functools
import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SYMBOLS = b"#*$%&|<>"


def base_counts(raw: bytes, words: list[bytes]) -> tuple[int, int, int, int]:
    """word_chars, n_symbols, n_dup_lines, n_repeat_words of a UTF-8 text and its words."""
    joined = b"".join(words)
    chars = len(joined) if joined.isascii() else len(joined.decode("utf-8", "replace"))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    seen: set[bytes] = set()
    again = 0
    for line in raw.split(b"\n"):
        if line in seen:
            again += 1
        elif line and not line.isspace():
            seen.add(line)
    return chars, symbols, again, repeat_words(words)


def repeat_words(words: list[bytes]) -> int:
    """Words within 3-word windows that occur twice or more, the first occurrence included."""
    n = len(words)
    if n < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    k = len(number)
    if k < 1 << 21:
        keys = (ids[:-2] * k + ids[1:-1]) * k + ids[2:]
    else:
        _, pairs = np.unique(ids[:-1] * k + ids[1:], return_inverse=True)
        keys = pairs[:-1] * k + ids[2:]
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    hit = np.zeros(n - 2, bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    for d in range(3):
        twice[d : n - 2 + d] |= hit
    return int(twice.sum())


def structure(raw: bytes, words: list[bytes], counts: tuple[int, int, int, int]) -> list[float]:
    """Bounded statistics of a text's shape; the last is 1 for a text without words, whose others are 0."""
    n = len(words)
    if not n:
        return [0.0] * (STRUCTURE - 1) + [1.0]
    chars, symbols, lines_again, repeated = counts
    of = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    size, upper = len(raw), int(of[65:91].sum())
    letters = upper + int(of[97:123].sum()) + int(of[128:].sum())
    return [
        min(1.0, math.log1p(n) / 10),
        min(1.0, chars / n / 20),
        min(1.0, 4 * symbols / size),
        lines_again / (int(of[10]) + 1),
        repeated / n,
        upper / max(letters, 1),
        min(1.0, 4 * int(of[48:58].sum()) / size),
        min(1.0, 10 * int(of[33]) / size),
        min(1.0, 5 * int(of[46]) / n),
        min(1.0, 20 * int(of[124]) / size),
        len(set(words)) / n,
        0.0,
    ]


STRUCTURE = 12


#: Texts of more bytes are not learned from (all are scored), which bounds what goes to the driver.
MOST_BYTES = 1 << 16


def labelled(docs: DataFrame, labels: DataFrame, most: int, held_out: bool = True) -> DataFrame:
    """text and quality of at most ``most`` labelled rows of each class, those of least hash, texts up to MOST_BYTES.

    Rows whose crc32(doc_id as text) mod 5 is 0 are held out.  A doc_id with several labels
    counts with its lowest, one with several texts with the least of them; null labels do not count.
    """
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5))
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
    if held_out:
        known = known.where(fold != 0)
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    # two top-n reads instead of a window over two keys: each task keeps `most` rows
    chosen = None
    for q in (0, 1):
        some = known.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        chosen = some if chosen is None else chosen.unionByName(some)
    # at most 2 * most rows of 12 bytes, whatever the input
    text = F.coalesce("text", F.lit(""))
    texts = docs.select("doc_id", text.alias("text")).where(F.octet_length("text") <= MOST_BYTES).join(F.broadcast(chosen), "doc_id")
    return texts.groupBy("doc_id", "quality").agg(F.min("text").alias("text")).select("doc_id", "text", "quality")


def word_hashes(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of some texts, in order, and the number of words of each text.

    A word's hash is the sum of byte * P**place, from prefix sums over the texts end to end.
    """
    buf = np.frombuffer(b"\n".join([*raws, b""]), np.uint8)
    if not len(buf):
        return np.zeros(0, np.uint64), np.zeros(len(raws), np.int64)
    blank = (buf == 32) | ((buf >= 9) & (buf <= 13))
    edge = np.diff(np.concatenate([[True], blank]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    with np.errstate(over="ignore"):
        powers, inverse = _powers(1 << max(16, int(len(buf)).bit_length()))
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * powers[: len(buf)], dtype=np.uint64)])
        h = (total[ends] - total[starts]) * inverse[starts]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    bounds = np.cumsum([len(r) + 1 for r in raws])
    per = np.diff(np.concatenate([[0], np.searchsorted(starts, bounds)]))
    return h, per


_P = 0x100000001B3


@functools.lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        up, down = np.full(n, _P, np.uint64), np.full(n, pow(_P, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def slices(texts: list[str], most: int = 1 << 20):
    """Runs of texts as UTF-8, each run about ``most`` bytes."""
    run, size = [], 0
    for t in texts:
        raw = t.encode("utf-8", "surrogatepass")
        run.append(raw)
        size += len(raw)
        if size >= most:
            yield run
            run, size = [], 0
    if run:
        yield run
