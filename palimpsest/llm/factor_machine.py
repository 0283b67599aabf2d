"""Quality score by a factorisation machine.

Features of a text are its hashed words (counts, scaled to unit length), the statistics of its
shape and, as metadata, a bucket of its length in bytes.  The score's interactions

    sum over i < j of <v_i, v_j> x_i x_j  =  1/2 sum over f of ((sum_i v_if x_i)**2 - sum_i (v_if x_i)**2)

take time linear in the features.  Weights and factors are trained on labelled rows of the four
training folds (a bounded sample, ``most`` of each class, weighted back to the classes' true
sizes, of texts up to ``quality.MOST_BYTES``); labels, lang, source and doc_id are never inputs of a
score.

Null and empty texts are scored by the feature that marks a text without words.  Without labels
of both classes every score is the share of label 1, or 0.5.  Repeated rows are scored once
each; doc_ids are whole numbers; a text is scored whole, in memory of some 50 times its size; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.quality import STRUCTURE, base_counts, labelled, slices, structure, word_hashes
from palimpsest.llm.shared import give_back, read_table, small

BITS, FACTORS, BUCKETS = 16, 8, 24
WORDS = 1 << BITS
SIZE = WORDS + STRUCTURE + BUCKETS
PREDICT_FROM = 0.3
OUT = "doc_id long, held_out boolean, score double, predicted int"


def features(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slots, values and the number of features of each text."""
    h, per = word_hashes(raws)
    n = len(raws)
    keys, counts = np.unique(np.repeat(np.arange(n), per) << BITS | (h >> np.uint64(64 - BITS)).astype(np.int64), return_counts=True)
    own = keys >> BITS
    values = counts / np.sqrt(np.maximum(np.bincount(own, counts.astype(np.float64) ** 2, n), 1))[own]
    shape = np.zeros((n, STRUCTURE))
    for i, raw in enumerate(raws):
        words = raw.split()
        shape[i] = structure(raw, words, base_counts(raw, words))
    length = np.array([min(BUCKETS - 1, len(r).bit_length()) for r in raws], np.int64)
    at = np.arange(n)
    slots = np.concatenate([keys & (WORDS - 1), np.tile(np.arange(STRUCTURE), n) + WORDS, length + WORDS + STRUCTURE])
    owner = np.concatenate([own, np.repeat(at, STRUCTURE), at])
    order = np.argsort(owner, kind="stable")
    return slots[order], np.concatenate([values, shape.ravel(), np.ones(n)])[order].astype(np.float32), np.bincount(owner, minlength=n)


class Machine:
    def __init__(self, seed: int = 7):
        self.bias = 0.0
        self.w = np.zeros(SIZE, np.float32)
        self.v = np.random.default_rng(seed).normal(0, 0.02, (SIZE, FACTORS)).astype(np.float32)

    def sums(self, slots, values, per):
        """Raw scores, and the factor sums that the gradient needs; each text has features."""
        starts = np.cumsum(per) - per
        vx = self.v[slots] * values[:, None]
        s = np.add.reduceat(vx, starts, 0)
        q = np.add.reduceat(vx * vx, starts, 0)
        z = self.bias + np.add.reduceat(self.w[slots] * values, starts) + 0.5 * (s * s - q).sum(1)
        return z, s, vx

    def score(self, raws: list[bytes]) -> np.ndarray:
        z, _, _ = self.sums(*features(raws))
        return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -35, 35)))


def train(texts: list[str], quality: np.ndarray, share: dict[int, float], epochs: int = 12, batch: int = 128, rate: float = 0.02, decay: float = 1e-4) -> Machine:
    """Adam over shuffled batches of logistic loss; share: true size of each class over its size in the sample."""
    m = Machine()
    y = np.asarray(quality, np.float64)
    weight = np.where(y > 0, share.get(1, 1.0), share.get(0, 1.0))
    if len(set(y)) < 2:
        mean = float(y.mean()) if len(y) else 0.5
        m.v[:] = 0
        m.bias = float(np.clip(np.log((mean + 1e-6) / (1 - mean + 1e-6)), -10, 10))
        return m
    weight /= weight.mean()
    prior = (y * weight).mean()
    m.bias = float(np.log(prior / (1 - prior)))
    raws = [t.encode("utf-8", "surrogatepass") for t in texts]
    rng, step = np.random.default_rng(11), 0
    parts = []
    order = rng.permutation(len(y))
    for lo in range(0, len(y), batch):
        at = order[lo : lo + batch]
        parts.append((features([raws[i] for i in at]), y[at], weight[at]))
    tables = [np.zeros((SIZE, FACTORS + 1), np.float32) for _ in range(2)]
    bias = [0.0, 0.0]
    for _ in range(epochs):
        for k in rng.permutation(len(parts)):
            (slots, values, per), yk, wk = parts[k]
            step += 1
            z, s, vx = m.sums(slots, values, per)
            err = (wk * (1 / (1 + np.exp(-np.clip(z, -35, 35))) - yk) / len(yk)).astype(np.float32)
            own = np.repeat(np.arange(len(yk)), per)
            e = err[own] * values
            uniq, back = np.unique(slots, return_inverse=True)
            grad = np.empty((len(uniq), FACTORS + 1), np.float32)
            grad[:, 0] = np.bincount(back, e, len(uniq))
            dv = e[:, None] * (s[own] - vx)
            for f in range(FACTORS):
                grad[:, f + 1] = np.bincount(back, dv[:, f], len(uniq))
            grad[:, 0] += decay * m.w[uniq]
            grad[:, 1:] += decay * m.v[uniq]
            first, second = tables
            first[uniq] = 0.9 * first[uniq] + 0.1 * grad
            second[uniq] = 0.99 * second[uniq] + 0.01 * grad * grad
            move = rate * first[uniq] / (np.sqrt(second[uniq]) + 1e-6)
            m.w[uniq] -= move[:, 0]
            m.v[uniq] -= move[:, 1:]
            g = float(err.sum())
            bias = [0.9 * bias[0] + 0.1 * g, 0.99 * bias[1] + 0.01 * g * g]
            m.bias -= rate * bias[0] / (bias[1] ** 0.5 + 1e-6)
    return m


def fit_machine(docs: DataFrame, labels: DataFrame, most: int = 2000) -> Machine:
    """Train on at most ``most`` labelled rows of each class, held-out fold apart; those go to the driver."""
    rows = labelled(docs, labels, most).toPandas().sort_values("doc_id", kind="stable")
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5))
    known = labels.where(F.col("quality").isin(0, 1) & (fold != 0)).groupBy("quality").agg(F.countDistinct("doc_id").alias("n"))
    sizes = {r["quality"]: r["n"] for r in known.collect()}
    got = rows["quality"].value_counts().to_dict()
    return train(rows["text"].tolist(), rows["quality"].to_numpy(), {q: max(1.0, sizes.get(q, n) / n) for q, n in got.items()})


def _scorer(model, threshold: float):
    def score(batches):
        m = model.value
        give_back()
        for b in small(batches):
            docs, at = b.column("doc_id"), 0
            for raws in slices(b.column("text").to_pylist()):
                ids = docs.slice(at, len(raws))
                at += len(raws)
                s = m.score(raws)
                held = [i is not None and zlib.crc32(str(i).encode()) % 5 == 0 for i in ids.to_pylist()]
                yield pa.RecordBatch.from_arrays([ids, pa.array(held), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return score


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = PREDICT_FROM, most: int = 2000) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs`` (doc_id, text)."""
    model = docs.sparkSession.sparkContext.broadcast(fit_machine(docs, labels, most))
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return texts.mapInArrow(_scorer(model, threshold), OUT)


def op7_quality_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
