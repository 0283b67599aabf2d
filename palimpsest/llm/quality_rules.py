"""Quality rules: base counts, and logistic regression over hashed word and character n-grams.

The regression sees the words, the word pairs and the n-grams of four characters (code points) of a
text, each family hashed into a table of weights and averaged over the text.  It is trained on labelled rows (a
bounded sample, ``most`` of each class, of texts up to ``quality.MOST_BYTES``, weighted back to the
classes' true sizes); one row in four is set aside to fit the Platt scaling, which makes its output a probability.  Scoring goes
through Arrow batches against a fixed threshold.

Null and empty texts have no words and fail the base rule.  Without labels of both classes the
verdict rests on the base rule alone.  Repeated rows are scored once each; doc_ids are whole numbers
(of any type in ``keep_good``); a text is scored whole, in memory of some 60 times its size; further
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.quality import base_counts, labelled, repeat_words, slices, word_hashes
from palimpsest.llm.shared import give_back, read_table, small

BITS = 18
KEEP_FROM = 0.5
OUT = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, probability double, kept boolean"


def _families(raws: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(slots, number of them in each text) of words, word pairs and four-character n-grams."""
    h, per = word_hashes(raws)
    shift = np.uint64(64 - BITS)
    with np.errstate(over="ignore"):
        words = (h >> shift).astype(np.int64)
        pair = (h[:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + h[1:]) * np.uint64(0x9E3779B97F4A7C15) >> shift
    starts = np.concatenate([[0], np.cumsum(per)])
    inside = np.ones(max(len(h) - 1, 0), bool)
    cut = starts[1:-1] - 1
    inside[cut[(cut >= 0) & (cut < len(inside))]] = False
    pairs = pair.astype(np.int64)[inside]
    n_pairs = np.maximum(per - 1, 0)
    # the n-grams of the texts end to end, and of those the ones within a text
    joined = b"".join(raws)
    sizes = np.array([len(r) for r in raws], np.int64)
    if joined.isascii():
        c = np.frombuffer(joined, np.uint8).astype(np.uint32)
    else:
        c = np.frombuffer(joined.decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), "<u4")
        begins = np.concatenate([[0], np.cumsum((np.frombuffer(joined, np.uint8) & 0xC0) != 0x80)])
        ends = np.cumsum(sizes)
        sizes = begins[ends] - begins[ends - sizes]
    grams = np.maximum(sizes - 3, 0)
    if len(c) < 4:
        return [(words, per), (pairs, n_pairs), (np.zeros(0, np.int64), grams)]
    with np.errstate(over="ignore"):
        code = c[:-3]
        for later in (c[1:-2], c[2:-1], c[3:]):
            code = code * np.uint32(0x01000193) + later
        code = (code ^ (code >> np.uint32(15))) * np.uint32(0x9E3779B1) >> np.uint32(32 - BITS)
    keep = np.ones(len(code), bool)
    ends = np.cumsum(sizes)
    for back in (1, 2, 3):
        at = ends - back
        keep[at[(at >= 0) & (at < len(code)) & (sizes >= back)]] = False
    short = np.flatnonzero((sizes > 0) & (sizes < 4))
    for i in short:
        keep[max(0, ends[i] - sizes[i]) : min(len(code), ends[i])] = False
    return [(words, per), (pairs, n_pairs), (code[keep].astype(np.int64), grams)]


def _counted(raws: list[bytes], step: int = 64) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text, slot, share of the text's) of each slot that a text has, by family, from a few texts at a time."""
    parts: list[list] = [[], [], []]
    for lo in range(0, len(raws), step):
        for part, (slots, per) in zip(parts, _families(raws[lo : lo + step])):
            keys, n = np.unique(np.repeat(np.arange(len(per)), per) << BITS | slots, return_counts=True)
            own = keys >> BITS
            part.append(((own + lo).astype(np.int32), (keys & ((1 << BITS) - 1)).astype(np.int32), (n / np.maximum(per, 1)[own]).astype(np.float32)))
    return [tuple(np.concatenate(x) for x in zip(*part)) for part in parts]


def _means(values: np.ndarray, per: np.ndarray) -> np.ndarray:
    """Mean of each run of values; 0 for an empty run."""
    total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    ends = np.cumsum(per)
    return (total[ends] - total[ends - per]) / np.maximum(per, 1)


class Model:
    """Weights of three families, a bias and the Platt scaling."""

    def __init__(self):
        self.tables = [np.zeros(1 << BITS, np.float32) for _ in range(3)]
        self.bias, self.scale, self.shift = 0.0, 1.0, 0.0

    def raw(self, raws: list[bytes]) -> np.ndarray:
        return self.bias + sum(_means(w[i], per) for w, (i, per) in zip(self.tables, _families(raws)))

    def probability(self, raws: list[bytes]) -> np.ndarray:
        z = np.clip(self.scale * self.raw(raws) + self.shift, -35, 35)
        return 1 / (1 + np.exp(-z))


def _platt(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Scale and shift by Newton's method, with Platt's smoothed targets."""
    pos, neg = y.sum(), len(y) - y.sum()
    t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    x, theta = np.stack([z, np.ones_like(z)], 1), np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -35, 35)))
        grad = x.T @ (weight * (p - t)) + 1e-3 * (theta - [1, 0])
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        theta = theta - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(max(theta[0], 1e-3)), float(theta[1])


def train(texts: list[str], quality: np.ndarray, share: dict[int, float], rounds: int = 40, rate: float = 0.5) -> Model:
    """share: true size of each class over its size in the sample."""
    model = Model()
    order = np.argsort([hash_of(t) for t in texts], kind="stable") if texts else np.zeros(0, int)
    texts, y = [texts[i] for i in order], np.asarray(quality, np.float64)[order]
    raws = [t.encode("utf-8", "surrogatepass") for t in texts]
    aside = np.arange(len(y)) % 4 == 3
    fit = np.flatnonzero(~aside)
    if len(set(y[~aside])) < 2 or len(set(y[aside])) < 2:
        model.shift = 35.0
        return model
    yf = y[fit]
    balance = np.where(yf > 0, 0.5 / yf.mean(), 0.5 / (1 - yf.mean()))
    families = _counted([raws[i] for i in fit])
    square = [np.full(1 << BITS, 1e-8) for _ in families]
    bias_square = 1e-8
    for _ in range(rounds):
        z = model.bias + sum(np.bincount(own, w[i] * v, len(fit)) for w, (own, i, v) in zip(model.tables, families))
        err = balance * (1 / (1 + np.exp(-np.clip(z, -35, 35))) - yf) / len(fit)
        for w, s, (own, i, v) in zip(model.tables, square, families):
            grad = np.bincount(i, err[own] * v, 1 << BITS)
            s += grad * grad
            w -= (rate * grad / np.sqrt(s)).astype(np.float32)
        g = err.sum()
        bias_square += g * g
        model.bias -= rate * g / bias_square**0.5
    z = model.raw([raws[i] for i in np.flatnonzero(aside)])
    model.scale, model.shift = _platt(z, y[aside], np.where(y[aside] > 0, share.get(1, 1.0), share.get(0, 1.0)))
    return model


def hash_of(text: str) -> int:
    import zlib

    return zlib.crc32(text.encode("utf-8", "surrogatepass"))


def fit_rules(docs: DataFrame, labels: DataFrame, most: int = 1500) -> Model:
    """Train on at most ``most`` labelled rows of each class; those go to the driver."""
    rows = labelled(docs, labels, most, held_out=False).toPandas().sort_values("doc_id", kind="stable")
    sizes = {r["quality"]: r["n"] for r in labels.where(F.col("quality").isin(0, 1)).groupBy("quality").agg(F.countDistinct("doc_id").alias("n")).collect()}
    got = rows["quality"].value_counts().to_dict()
    return train(rows["text"].tolist(), rows["quality"].to_numpy(), {q: max(1.0, sizes.get(q, n) / n) for q, n in got.items()})


def _scorer(model, threshold: float):
    def score(batches):
        m = model.value
        give_back()
        for b in small(batches):
            ids, at = b.column("doc_id"), 0
            for raws in slices(b.column("text").to_pylist()):
                words = [r.split() for r in raws]
                counts = [base_counts(r, w) for r, w in zip(raws, words)]
                n = np.array([len(w) for w in words], np.int64)
                c = np.array(counts, np.int64).reshape(len(raws), 4)
                failed = (n < 50) | (100 * c[:, 3] > 50 * n)
                p = m.probability(raws)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(at, len(raws)), *(pa.array(x) for x in (n, c[:, 0], c[:, 1], c[:, 2], c[:, 3], failed, p, ~failed & (p >= threshold)))],
                    ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "probability", "kept"],
                )
                at += len(raws)

    return score


def apply_rules(docs: DataFrame, labels: DataFrame, threshold: float = KEEP_FROM, most: int = 1500) -> DataFrame:
    """Counts, base verdict, calibrated probability and verdict of every row of ``docs`` (doc_id, text)."""
    model = docs.sparkSession.sparkContext.broadcast(fit_rules(docs, labels, most))
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return texts.mapInArrow(_scorer(model, threshold), OUT)


def _filter(model, threshold: float):
    def keep(batches):
        m = model.value
        give_back()
        for b in small(batches):
            verdict: list[bool] = []
            for raws in slices([t or "" for t in b.column("text").to_pylist()]):
                words = [r.split() for r in raws]
                failed = [len(w) < 50 or 100 * repeat_words(w) > 50 * len(w) for w in words]
                verdict += (~np.array(failed) & (m.probability(raws) >= threshold)).tolist()
            yield b.filter(pa.array(verdict, pa.bool_()))

    return keep


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = KEEP_FROM, most: int = 1500) -> DataFrame:
    """The rows of ``docs``, all columns, that ``apply_rules`` keeps."""
    model = docs.sparkSession.sparkContext.broadcast(fit_rules(docs, labels, most))
    return docs.mapInArrow(_filter(model, threshold), docs.schema)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_rules(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
