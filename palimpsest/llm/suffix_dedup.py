"""Removal of repeated passages by a distributed sort of sampled suffixes.

A byte goes if a string of ``size`` (50) bytes over it also starts in a document with a smaller
doc_id.  All strings of that length are judged on the input; matches never cross documents.

Not every suffix has to be sorted.  Of each window of ``size`` bytes the anchor is the start of
its 20-byte string of least hash (the leftmost of equals), so equal windows have their anchors at
the same place, and the windows of an anchor are consecutive.  The steps:

1. Each chunk of documents lists the hashes of its anchors' 20-byte strings, sorted and
   delta-coded; an exchange by hash finds those in two documents or more.  The others' windows
   occur once and are done with.
2. For each remaining anchor a chunk takes the suffix from it (up to ``size`` bytes, as far as
   its windows reach), followed by the bytes before it in reverse.  Equal ones are one entry with
   their least doc_id.  A chunk's entries, sorted, are a run.  Runs are front-coded, each entry
   as the length of the prefix it shares with the one before it and the rest, and exchanged.
3. A loser tree merges the runs of an exchange bucket.  It knows for each entry the length of
   the prefix it shares with the last winner: of two that differ in it the longer one wins unread,
   and of two with equal lengths only what follows is compared.  The merge yields the sorted
   entries with their common prefixes.
4. Windows that start o bytes before their anchor are equal if they lie in a stretch of common
   prefixes of at least ``size`` - o and agree in the o bytes before; each such group has a least
   doc_id, and windows of larger ones are marked.
5. Each chunk reads its marks, and windows of all but the least document of an entry join them.

Equal windows of one chunk are one entry however many documents hold them, so a passage in a
third of all documents gives one entry for each chunk.  Where such a passage ends, though, one
anchor has as many different continuations as there are documents.  Strings of 20 bytes with over
``HOT`` entries in all therefore give an entry for each single window, whose exchange bucket comes
from all of its bytes, so that no bucket grows with them.  Chunks are told by scan partition and
place in it; a checksum over rows stops the run if a later scan should deal rows differently.

Hashes only bring candidates together: entries and windows with equal ones are compared byte by byte.
A long text is searched for anchors in overlapping slices, so it may be of any length that a row
holds; some 20 times its size is in memory at once.

Null and empty texts lose nothing; null doc_ids count as greater than all others, and so does the
greatest number that a doc_id can be; doc_ids are whole numbers; rows with one doc_id never remove
bytes from each other; further columns pass through ``remove_repeats``; an empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.shared import filesystem, give_back, read_table, shared_path

K = 20
PLACE_BITS = 28
CHUNK_BYTES = 8 << 20
SLICE_BYTES = 1 << 17
BUCKET_ENTRIES = 64_000
FREQUENT, HOT = 8, 2_000
LAST = np.iinfo(np.int64).max


# ---------------------------------------------------------------- anchors


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = a * np.uint64(0x9E3779B97F4A7C15) + b
        h ^= h >> np.uint64(29)
    return h


def _string_hashes(b: np.ndarray) -> np.ndarray:
    """Hash of the K bytes from each place, from halves of doubling length."""
    h = b.astype(np.uint64)
    by = {1: h}
    for n in (1, 2, 4, 8):
        by[2 * n] = h = _mixed(h[:-n], h[n:])
    h = _mixed(by[16][: len(by[4]) - 16], by[4][16:])
    with np.errstate(over="ignore"):
        h *= np.uint64(0xC2B2AE3D27D4EB4F)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


class Chunk:
    """Some documents end to end, and the anchors of their windows.

    place: of each anchor; first, last: its windows' starts; doc: index of its document;
    code: 48 bits of another mix of its hash.
    """

    def __init__(self, doc_ids: list, texts: list, size: int):
        self.size = size
        self.raws = [t.encode("utf-8", "surrogatepass") for t in texts]
        self.docs = np.array([LAST if d is None else d for d in doc_ids], np.int64)
        self.ends = np.cumsum([len(r) for r in self.raws], dtype=np.int64)
        self.starts = self.ends - np.array([len(r) for r in self.raws], np.int64)
        self.bytes = np.frombuffer(b"".join(self.raws), np.uint8)
        before = size - K
        self.padded = np.concatenate([np.zeros(before, np.uint8), self.bytes, np.zeros(size, np.uint8)])
        self.bytes = self.padded[before : before + len(self.bytes)]
        self._anchors()

    @property
    def check(self) -> int:
        return zlib.crc32(self.ends.tobytes(), zlib.crc32(self.docs.tobytes()))

    def code_at(self, place: np.ndarray) -> np.ndarray:
        return self.code[np.searchsorted(self.place, place)]

    def _anchors(self) -> None:
        found = [(np.zeros(0, np.int64),) * 5]
        lo = 0
        while lo < len(self.raws):
            hi = lo + 1
            while hi < len(self.raws) and self.ends[hi] - self.starts[lo] <= SLICE_BYTES:
                hi += 1
            # slices of one long text overlap, so that each window is whole in one of them
            for at in range(int(self.starts[lo]), int(self.ends[hi - 1]), SLICE_BYTES) if hi == lo + 1 else (int(self.starts[lo]),):
                stop = min(at + SLICE_BYTES + self.size - 1, int(self.ends[hi - 1]))
                if stop - at >= self.size:
                    found.append(self._slice(lo, hi, at, stop))
            lo = hi
        place, first, last, doc, code = (np.concatenate(x) for x in zip(*found))
        # windows of one anchor that two slices hold are one run
        goes_on = place[1:] == place[:-1]
        begins, ends = np.ones(len(place), bool), np.ones(len(place), bool)
        begins[1:], ends[:-1] = ~goes_on, ~goes_on
        self.place, self.first, self.last, self.doc, self.code = place[begins], first[begins], last[ends], doc[begins], code[begins]

    def _slice(self, lo: int, hi: int, base: int, stop: int):
        size, b = self.size, self.bytes[base:stop]
        h = _string_hashes(b)
        # upper bits of the hash, then the place: the least is the leftmost of least hash
        least = (h >> np.uint64(PLACE_BITS)) << np.uint64(PLACE_BITS) | np.arange(len(h), dtype=np.uint64)
        span, have = size - K + 1, 1
        while 2 * have <= span:
            least = np.minimum(least[:-have], least[have:])
            have *= 2
        if have < span:
            least = np.minimum(least[: len(least) - (span - have)], least[span - have :])
        ends, starts = np.minimum(self.ends[lo:hi], stop) - base, np.maximum(self.starts[lo:hi], base) - base
        inside = np.zeros(len(least) + 1, np.int64)
        ok = ends - starts >= size
        inside[starts[ok]] += 1
        np.add.at(inside, ends[ok] - size + 1, -1)
        at = np.flatnonzero(np.cumsum(inside[:-1]))
        place = (least[at] & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
        cut = np.flatnonzero(np.diff(place)) + 1
        begin, end = np.concatenate([[0], cut]), np.concatenate([cut, [len(at)]]) - 1
        if not len(at):
            return (np.zeros(0, np.int64),) * 5
        place = place[begin]
        doc = np.searchsorted(ends, place, side="right")
        # anchors have small hashes, so codes come from another mix of them
        with np.errstate(over="ignore"):
            code = h[place] * np.uint64(0xD6E8FEB86659FD93)
            code ^= code >> np.uint64(32)
            code *= np.uint64(0x9E3779B97F4A7C15)
        return place + base, at[begin] + base, at[end] + base, doc + lo, (code >> np.uint64(16)).astype(np.int64)

    def codes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct codes in order, whether each is in two documents of this chunk, and its number of entries here."""
        order = np.lexsort((self.doc, self.code))
        code, doc = self.code[order], self.docs[self.doc[order]]
        new = np.concatenate([[True], code[1:] != code[:-1]]) if len(code) else np.zeros(0, bool)
        begin = np.flatnonzero(new)
        if not len(begin):
            return code, new, np.zeros(0, np.int64)
        n = np.diff(np.concatenate([begin, [len(code)]]))
        # copies of a text are one entry: where a code is frequent, entries are counted and not anchors
        many = np.flatnonzero(n > FREQUENT)
        if len(many):
            own = order[np.repeat(n > FREQUENT, n)]
            e = Entries(self, self.place[own], self.first[own], self.last[own], self.doc[own])
            found, counts = np.unique(self.code[own[e.of]], return_counts=True)
            n[np.searchsorted(code[begin], found)] = counts
        return code[begin], np.maximum.reduceat(doc, begin) != np.minimum.reduceat(doc, begin), n

    def entries(self, wanted: np.ndarray, hot: np.ndarray) -> "Entries":
        """Entries of the anchors whose codes are in ``wanted``, a sorted array; ``hot`` marks codes that go by single windows."""
        if not len(wanted) or not len(self.code):
            none = np.zeros(0, np.int64)
            return Entries(self, none, none, none, none)
        at = np.minimum(np.searchsorted(wanted, self.code), len(wanted) - 1)
        found = wanted[at] == self.code
        own, single = np.flatnonzero(found & ~hot[at]), np.flatnonzero(found & hot[at])
        n = self.last[single] - self.first[single] + 1
        window = np.repeat(self.first[single] - np.concatenate([[0], np.cumsum(n)[:-1]]) if len(n) else n, n) + np.arange(n.sum())
        join = lambda a, b: np.concatenate([a[own], b])
        return Entries(self, join(self.place, window), join(self.first, window), join(self.last, window), join(self.doc, np.repeat(self.doc[single], n)), len(own))


class Entries:
    """Distinct entries of a chunk, as rows of fixed width.

    place, first, last, doc: of each anchor, or of each single window after ``anchors`` of those.
    A row has size + before + 2 bytes: the suffix, the reversed bytes before, then the least and
    largest o of the windows.  entry: the entry of each; of, least: a row and the least doc_id of
    each entry.  Rows are made some at a time and not kept.
    """

    def __init__(self, chunk: Chunk, place, first, last, doc, anchors: int | None = None):
        self.chunk, self.place, self.first, self.last, self.doc = chunk, place, first, last, doc
        self.anchors, n = len(place) if anchors is None else anchors, len(place)
        # equal rows by two hashes of them; an entry's number is its rank by hash, and ``ordered`` sorts
        h1, h2 = np.empty(n, np.uint64), np.empty(n, np.uint64)
        for lo in range(0, n, BLOCK):
            words = _words(self.rows(np.arange(lo, min(n, lo + BLOCK))))
            with np.errstate(over="ignore"):
                h1[lo : lo + BLOCK], h2[lo : lo + BLOCK] = words @ _FACTORS[0][: words.shape[1]], words @ _FACTORS[1][: words.shape[1]]
        h1 ^= h1 >> np.uint64(31)
        order = np.lexsort((h2, h1))
        h1, h2 = h1[order], h2[order]
        new = np.ones(n, bool)
        new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        same = np.flatnonzero(~new)
        for lo in range(0, len(same), BLOCK):
            at = same[lo : lo + BLOCK]
            new[at[(self.rows(order[at]) != self.rows(order[at - 1])).any(1)]] = True
        begin = np.flatnonzero(new)
        self.entry = np.empty(n, np.int64)
        self.entry[order] = np.cumsum(new) - 1
        self.of, self.hash = order[begin], h1[begin]
        docs = chunk.docs[doc]
        self.least = np.minimum.reduceat(docs[order], begin) if n else docs

    def rows(self, at: np.ndarray) -> np.ndarray:
        size, before = self.chunk.size, self.chunk.size - K
        place, near, far = self.place[at], (self.place - self.last)[at], (self.place - self.first)[at]
        text = np.zeros((len(at), size + before + 2), np.uint8)
        if len(at):
            views = np.lib.stride_tricks.sliding_window_view(self.chunk.padded, size + before)[place]
            text[:, :size] = views[:, before:]
            text[:, size : size + before] = views[:, before - 1 :: -1]
            text[:, :size][np.arange(size)[None, :] >= (size - near)[:, None]] = 0
            text[:, size : size + before][np.arange(before)[None, :] >= far[:, None]] = 0
            text[:, -2], text[:, -1] = near, far
        return text

    def ordered(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers, rows and exchange codes of the entries, by rows in order."""
        n = len(self.of)
        text = np.empty((n, 2 * self.chunk.size - K + 2), np.uint8)
        for lo in range(0, n, BLOCK):
            text[lo : lo + BLOCK] = self.rows(self.of[lo : lo + BLOCK])
        order = sorted_rows(text)
        with np.errstate(over="ignore"):
            code = (self.hash * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(16)).astype(np.int64)
        anchors = np.flatnonzero(self.of < self.anchors)
        code[anchors] = self.chunk.code_at(self.place[self.of[anchors]])
        return order, text[order], code[order]


BLOCK = 1 << 16
_FACTORS = np.random.default_rng(3).integers(1, 1 << 63, (2, 64), np.uint64) * np.uint64(2) + np.uint64(1)


def _words(text: np.ndarray) -> np.ndarray:
    wide = np.zeros((len(text), -(-text.shape[1] // 8) * 8), np.uint8)
    wide[:, : text.shape[1]] = text
    return wide.view(">u8").astype(np.uint64)


def sorted_rows(text: np.ndarray) -> np.ndarray:
    """Order of byte rows: by their first 24 bytes, and the few that agree in them by the rest."""
    words = _words(text[:, :24])
    order = np.lexsort([words[:, i] for i in (2, 1, 0)])
    head = words[order]
    same = np.zeros(len(order) + 1, bool)
    same[1:-1] = (head[1:] == head[:-1]).all(1)
    tied = np.flatnonzero(same[1:] | same[:-1])
    if len(tied):
        group = np.cumsum(~same[:-1])[tied]
        rest = _words(text[order[tied], 24:])
        order[tied] = order[tied[np.lexsort([rest[:, i] for i in range(rest.shape[1] - 1, -1, -1)] + [group])]]
    return order


def chunks(batches, size: int):
    """(chunk number in this scan partition, its record batches, Chunk), by bytes and not by batch."""
    number, held, ids, texts, total = 0, [], [], [], 0
    for b in (b.slice(at, 1000) for b in batches for at in range(0, len(b), 1000)):
        of, ts, lo = b.column("doc_id").to_pylist(), b.column("text").to_pylist(), 0
        for i, t in enumerate(ts):
            ids.append(of[i])
            texts.append(t or "")
            total += len(texts[-1])
            if total >= CHUNK_BYTES:
                held.append(b.slice(lo, i + 1 - lo))
                yield number, held, Chunk(ids, texts, size)
                give_back()
                number, held, ids, texts, total, lo = number + 1, [], [], [], 0, i + 1
        if lo < len(ts):
            held.append(b.slice(lo))
    if ids:
        yield number, held, Chunk(ids, texts, size)
    del held, ids, texts
    give_back()


# ---------------------------------------------------------------- codes in two documents


def pack_codes(codes: np.ndarray, bits: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted 48-bit codes as differences of 4 bytes where all fit, with a bit and a count up to 65,535 for each."""
    gaps = np.diff(codes, prepend=codes[:1])
    narrow = not len(gaps) or int(gaps.max()) < 1 << 32
    head = np.array([len(codes), int(codes[0]) if len(codes) else 0, narrow], "<i8")
    return head.tobytes() + gaps.astype("<u4" if narrow else "<i8").tobytes() + np.minimum(counts, 65_535).astype("<u2").tobytes() + np.packbits(bits).tobytes()


def unpack_codes(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, first, narrow = np.frombuffer(blob, "<i8", 3).tolist()
    gaps = np.frombuffer(blob, "<u4" if narrow else "<i8", n, 24).astype(np.int64)
    at = 24 + n * (4 if narrow else 8)
    counts = np.frombuffer(blob, "<u2", n, at).astype(np.int64)
    return np.cumsum(gaps) + first, np.unpackbits(np.frombuffer(blob, np.uint8, -1, at + 2 * n), count=n).astype(bool), counts


def shift_for(buckets: int) -> int:
    """A code's bucket is its first bits, the code shifted so far: a power of two of buckets, ``buckets`` at least."""
    return 48 - min(31, (max(1, buckets) - 1).bit_length())


def _ranges(bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The buckets that occur in a sorted array, where each begins and where it ends; buckets that do not occur cost nothing."""
    full, begin = np.unique(bucket, return_index=True)
    return full, begin, np.append(begin[1:], len(bucket))


def _list_codes(size: int, shift: int):
    def run(batches):
        part = TaskContext.get().partitionId()
        for number, _, c in chunks(batches, size):
            codes, twice, counts = c.codes()
            full, begin, end = _ranges(codes >> shift)
            blobs = [pack_codes(codes[lo:hi], twice[lo:hi], counts[lo:hi]) for lo, hi in zip(begin.tolist(), end.tolist())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(full.astype(np.int32)), pa.array(np.full(len(full), part, np.int32)), pa.array(np.full(len(full), number, np.int32)), pa.array(np.full(len(full), c.check)), pa.array(blobs, pa.binary())],
                ["bucket", "part", "chunk", "crc", "blob"],
            )

    return run


def _find_common(key, table):
    give_back()
    lists = [unpack_codes(b) for b in table.column("blob").to_pylist()]
    values, back, times = np.unique(np.concatenate([c for c, _, _ in lists]), return_inverse=True, return_counts=True)
    entries = np.bincount(back, np.concatenate([n for _, _, n in lists]), len(values))
    wanted = times > 1
    wanted[back[np.concatenate([t for _, t, _ in lists])]] = True
    common, entries = values[wanted], entries[wanted]
    blobs, sizes = [], []
    for c, _, n in lists:
        at = np.searchsorted(common, c)
        at = at[(at < len(common)) & (common[np.minimum(at, len(common) - 1)] == c)] if len(common) else at[:0]
        blobs.append(pack_codes(common[at], entries[at] > HOT, np.ones(len(at))))
        sizes.append(len(at))
    return pa.table({"part": table.column("part"), "chunk": table.column("chunk"), "crc": table.column("crc"), "n": pa.array(sizes, pa.int64()), "blob": pa.array(blobs, pa.binary())})


# ---------------------------------------------------------------- side tables by scan partition


def _by_part(df: DataFrame, name: str) -> str:
    """Write a small table in a folder for each scan partition; its path."""
    path = shared_path(df.sparkSession, name)
    df.repartition("part").write.partitionBy("part").parquet(path)
    return path


def _side(path: str, part: int) -> dict[int, list[dict]]:
    """What a scan partition's folder holds, by chunk."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    files, at = filesystem(f"{path}/part={part}")
    out: dict[int, list[dict]] = {}
    for f in files.get_file_info(fs.FileSelector(at, allow_not_found=True)):
        if f.path.endswith(".parquet"):
            with files.open_input_file(f.path) as source:
                for r in pq.ParquetFile(source).read().to_pylist():
                    out.setdefault(r["chunk"], []).append(r)
    return out


def _wanted(rows: list[dict], c: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Sorted codes that a chunk shares, and which of them are hot."""
    if any(r["crc"] != c.check for r in rows):
        raise RuntimeError("documents came in another order than before; store the table first")
    lists = [unpack_codes(r["blob"]) for r in rows]
    codes, hot = np.concatenate([np.zeros(0, np.int64), *(x[0] for x in lists)]), np.concatenate([np.zeros(0, bool), *(x[1] for x in lists)])
    order = np.argsort(codes)
    return codes[order], hot[order]


# ---------------------------------------------------------------- sorted runs


def front_code(text: np.ndarray) -> bytes:
    """Rows in sorted order: of each the length of the prefix shared with the one before, then all rests."""
    n, width = text.shape
    shared = np.zeros(n, np.int64)
    if n > 1:
        differ = text[1:] != text[:-1]
        shared[1:] = np.where(differ.any(1), differ.argmax(1), width)
    rest = text[np.arange(width)[None, :] >= shared[:, None]]
    return np.array([n, width], "<i4").tobytes() + shared.astype(np.uint8).tobytes() + rest.tobytes()


def coded_rows(blob: bytes):
    """(shared, row) of each row of a front-coded run, one at a time."""
    n, width = np.frombuffer(blob, "<i4", 2).tolist()
    at, row = 8 + n, b""
    for shared in blob[8 : 8 + n]:
        end = at + width - shared
        row = row[:shared] + blob[at:end]
        at = end
        yield shared, row


def merge_runs(runs: list):
    """Loser tree over iterators of (shared with the one before, row): yields (run, row, shared with the last).

    Each waiting row carries the length of the prefix it shares with the last winner that passed
    it.  Of two, the longer length wins unread; at equal lengths only what follows is compared.
    """
    k = 1
    while k < len(runs):
        k *= 2
    its = [iter(r) for r in runs] + [iter(()) for _ in range(k - len(runs))]
    rows: list[bytes | None] = [None] * k
    known = [0] * k
    for i, it in enumerate(its):
        got = next(it, None)
        if got is not None:
            rows[i] = got[1]
    losers = [0] * k

    def play(a: int, b: int) -> tuple[int, int]:
        """Winner and loser; the loser's known length becomes that with the winner."""
        x, y = rows[a], rows[b]
        if y is None:
            return a, b
        if x is None:
            return b, a
        la, lb = known[a], known[b]
        if la != lb:
            return (a, b) if la > lb else (b, a)
        x, y = x[la:], y[la:]
        if x == y:
            known[b] = la + len(y)
            return a, b
        same = len(x) - ((int.from_bytes(x, "big") ^ int.from_bytes(y, "big")).bit_length() + 7) // 8
        if x < y:
            known[b] = la + same
            return a, b
        known[a] = la + same
        return b, a

    def build(node: int) -> int:
        if node >= k:
            return node - k
        winner, losers[node] = play(build(2 * node), build(2 * node + 1))
        return winner

    top = build(1) if k > 1 else 0
    while rows[top] is not None:
        yield top, rows[top], known[top]
        got = next(its[top], None)
        if got is None:
            rows[top] = None
        else:
            known[top], rows[top] = got
        winner, node = top, (top + k) >> 1
        while node:
            other = losers[node]
            x, y = rows[winner], rows[other]
            if y is not None:
                if x is None or known[other] > known[winner]:
                    losers[node], winner = winner, other
                elif known[other] == known[winner]:
                    winner, losers[node] = play(winner, other)
            node >>= 1
        top = winner


def _list_runs(size: int, shift: int, side: str):
    def run(batches):
        part = TaskContext.get().partitionId()
        codes = _side(side, part)
        for number, _, c in chunks(batches, size):
            e = c.entries(*_wanted(codes.get(number, []), c))
            number_of, text, code = e.ordered()
            bucket = code >> shift
            rows: list[tuple] = []
            order = np.argsort(bucket, kind="stable")
            for i, lo, hi in zip(*(x.tolist() for x in _ranges(bucket[order]))):
                of = order[lo:hi]
                rows.append((i, part, number, c.check, number_of[of].astype("<u4").tobytes(), e.least[number_of[of]].astype("<i8").tobytes(), front_code(text[of])))
            names = ["bucket", "part", "chunk", "crc", "entries", "least", "run"]
            kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows) if rows else [()] * 7, kinds)], names)

    return run


def marks(text: np.ndarray, shared: np.ndarray, least: np.ndarray, size: int) -> np.ndarray:
    """For sorted entries: bit o is set if the window o bytes before the anchor is in a smaller document."""
    n, before = len(text), size - K
    least = np.asarray(least)
    bits = np.zeros(n, np.uint64)
    near, far = text[:, -2].astype(np.int64), text[:, -1].astype(np.int64)
    following = np.concatenate([shared[1:], [0]])
    longest = np.maximum(shared, following)
    left = np.zeros(n, np.uint64)
    for o in range(before + 1):
        if o:
            with np.errstate(over="ignore"):
                left = left * np.uint64(0x9E3779B97F4A7C15) + text[:, size + o - 1] + np.uint64(1)
                left ^= left >> np.uint64(31)
        at = np.flatnonzero((near <= o) & (o <= far) & (longest >= size - o))
        if len(at) < 2:
            continue
        stretch = np.cumsum(shared < size - o)
        with np.errstate(over="ignore"):
            key = (left + stretch.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))[at] * np.uint64(0x9E3779B97F4A7C15)
        order = np.argsort(key)
        new = np.concatenate([[True], key[order[1:]] != key[order[:-1]]])
        if _differ(text[:, size : size + o], stretch, at[order], new).any():  # two windows of one hash
            order = np.lexsort([*text[at, size : size + o].T, stretch[at]])
            new = np.concatenate([[True], np.zeros(len(at) - 1, bool)])
            new[1:] = _differ(text[:, size : size + o], stretch, at[order], new)
        at = at[order]
        group = np.cumsum(new) - 1
        first = np.minimum.reduceat(least[at], np.flatnonzero(new))
        bits[at[first[group] < least[at]]] |= np.uint64(1 << o)
    return bits


def _differ(left: np.ndarray, stretch: np.ndarray, at: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Which of ``at`` but the first, where not ``new``, differ from the one before in the bytes before or in their stretch."""
    same = np.flatnonzero(~new[1:])
    x, y = at[same + 1], at[same]
    out = np.zeros(len(at) - 1, bool)
    out[same] = (stretch[x] != stretch[y]) | (left[x] != left[y]).any(1)
    return out


def _merge(size: int):
    def run(key, table):
        give_back()
        rows = sorted(table.to_pylist(), key=lambda r: (r["part"], r["chunk"]))
        width = 2 * size - K + 2
        text, shared, of = bytearray(), [], []
        for r, row, same in merge_runs([coded_rows(r["run"]) for r in rows]):
            text += row
            shared.append(same)
            of.append(r)
        of = np.array(of, np.int64)
        rank = np.argsort(of, kind="stable")  # within a run, entries come in its order
        least = np.empty(len(of), np.int64)
        least[rank] = np.concatenate([np.frombuffer(r["least"], "<i8") for r in rows])
        bits = marks(np.frombuffer(bytes(text), np.uint8).reshape(-1, width), np.array(shared, np.int64), least, size)[rank]
        out, at = [], 0
        for r in rows:
            entry = np.frombuffer(r["entries"], "<u4")
            own = bits[at : at + len(entry)]
            at += len(entry)
            if own.any():
                out.append((r["part"], r["chunk"], r["crc"], entry[own > 0].tobytes(), own[own > 0].astype("<u8").tobytes()))
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
        return pa.table([pa.array(x, t) for x, t in zip(zip(*out) if out else [()] * 5, kinds)], ["part", "chunk", "crc", "entries", "bits"])

    return run


# ---------------------------------------------------------------- covered bytes


def covered(c: Chunk, e: Entries, rows: list[dict]) -> np.ndarray:
    """Which bytes of a chunk go."""
    bits = np.zeros(len(e.least), np.uint64)
    for r in rows:
        bits[np.frombuffer(r["entries"], "<u4")] |= np.frombuffer(r["bits"], "<u8")
    edges = np.zeros(len(c.bytes) + 1, np.int32)
    later = c.docs[e.doc] > e.least[e.entry]
    np.add.at(edges, e.first[later], 1)
    np.add.at(edges, e.last[later] + 1, -1)
    hit = np.cumsum(edges[:-1], dtype=np.int32) > 0
    rest, own = e.place[~later], bits[e.entry[~later]]
    for o in range(c.size - K + 1):
        some = rest[(own >> np.uint64(o) & np.uint64(1)).astype(bool)]
        hit[some - o] = True
    # a window reaches size - 1 bytes on; the windows of a document end in it
    gone, reach = hit, 1
    while reach < c.size:
        step = min(reach, c.size - reach)
        wider = gone.copy()
        wider[step:] |= gone[:-step]
        gone, reach = wider, reach + step
    return gone


def by_document(c: Chunk, flags: np.ndarray) -> np.ndarray:
    """Number of set flags, one for each byte, of each document."""
    n, full = np.zeros(len(c.ends), np.int64), c.ends > c.starts
    if full.any():
        n[full] = np.add.reduceat(flags.view(np.uint8), c.starts[full], dtype=np.int64)
    return n


def _finish(size: int, codes_path: str, marks_path: str, texts: bool):
    def run(batches):
        part = TaskContext.get().partitionId()
        codes, found = _side(codes_path, part), _side(marks_path, part)
        for number, held, c in chunks(batches, size):
            e = c.entries(*_wanted(codes.get(number, []), c))
            gone = covered(c, e, found.get(number, []))
            removed = by_document(c, gone)
            kept = [r if not n else r_of(c, gone, i) for i, (r, n) in enumerate(zip(c.raws, removed.tolist()))]
            if texts:
                table = pa.Table.from_batches(held)
                new = pa.array([None if t is None and not n else k.decode("utf-8", "ignore") for t, n, k in zip(table.column("text").to_pylist(), removed.tolist(), kept)], pa.string())
                yield from table.set_column(table.schema.get_field_index("text"), "text", new).combine_chunks().to_batches()
                continue
            edge = gone.copy()
            edge[1:] &= ~gone[:-1]
            begins = c.starts[c.ends > c.starts]
            edge[begins] = gone[begins]
            spans = by_document(c, edge)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.concat_arrays([b.column("doc_id") for b in held]),
                    pa.array(c.ends - c.starts),
                    pa.array(removed),
                    pa.array(spans),
                    pa.array([hashlib.sha256(k).hexdigest() for k in kept]),
                ],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    return run


def r_of(c: Chunk, gone: np.ndarray, i: int) -> bytes:
    at = slice(c.starts[i], c.ends[i])
    return c.bytes[at][~gone[at]].tobytes()


def _found(docs: DataFrame, size: int) -> tuple[str, str]:
    """Paths of the candidate codes and of the marks, by scan partition."""
    spark = docs.sparkSession
    # all scans must deal rows alike, however many executors there are by then
    if spark.conf.get("spark.sql.files.minPartitionNum", None) in (None, ""):
        spark.conf.set("spark.sql.files.minPartitionNum", str(spark.sparkContext.defaultParallelism))
    # small Arrow batches: executors hold a batch of whole texts several times over
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", min(2000, int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))))
    rows = docs.select("doc_id", "text")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    listed = rows.mapInArrow(_list_codes(size, shift_for(-(-total // (12 << 20)))), "bucket int, part int, chunk int, crc long, blob binary")
    common = listed.groupBy("bucket").applyInArrow(_find_common, "part int, chunk int, crc long, n long, blob binary")
    codes = _by_part(common, "codes")
    n = spark.read.schema("part int, n long").parquet(codes).agg(F.sum("n")).first()[0] or 0
    runs = rows.mapInArrow(_list_runs(size, shift_for(-(-n // BUCKET_ENTRIES)), codes), "bucket int, part int, chunk int, crc long, entries binary, least binary, run binary")
    found = runs.groupBy("bucket").applyInArrow(_merge(size), "part int, chunk int, crc long, entries binary, bits binary")
    return codes, _by_part(found, "marks")


def repeats(docs: DataFrame, size: int = 50) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row of ``docs`` (doc_id, text), a table read from files."""
    codes, found = _found(docs, size)
    return docs.select("doc_id", "text").mapInArrow(_finish(size, codes, found, False), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove_repeats(docs: DataFrame, size: int = 50) -> DataFrame:
    """``docs`` with the removed bytes gone from ``text``; of a character cut in two the rest goes as well."""
    codes, found = _found(docs, size)
    return docs.mapInArrow(_finish(size, codes, found, True), docs.schema)


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(read_table(spark, sf_dir, "documents"))
