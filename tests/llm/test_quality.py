import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cases import space_words
from palimpsest.llm import factor_machine, quality, quality_rules

SF = "/root/testdata/sf0.01"


def base(t):
    t = t or ""
    w = space_words(t)
    lines, seen, dup = t.split("\n"), set(), 0
    for x in lines:
        if space_words(x):
            dup += x in seen
            seen.add(x)
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    again = {j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(again), len(w) < 50 or 100 * len(again) > 50 * len(w)


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def test_base_counts(docs, rows, none, tables):
    got = quality_rules.apply_rules(docs, tables[1].limit(0)).collect()
    assert sorted(tuple(r)[:7] for r in got) == sorted((d, *base(t)) for d, t in rows)
    assert all(r["kept"] is not r["base_failed"] for r in got)  # without labels the base rule alone decides
    assert sorted(r["doc_id"] for r in quality_rules.keep_good(docs, tables[1].limit(0)).collect()) == sorted(d for d, t in rows if not base(t)[5])
    assert quality_rules.apply_rules(none, tables[1]).count() == 0


def test_rules_on_labelled_rows(tables):
    docs, labels = tables
    marks = {r["doc_id"]: r["quality"] for r in labels.collect()}
    got = [r for r in quality_rules.apply_rules(docs, labels).collect() if r["doc_id"] in marks and not r["base_failed"]]
    right = sum(r["kept"] == (marks[r["doc_id"]] == 1) for r in got)
    assert right >= 0.97 * len(got)
    bad = [r["probability"] for r in got if not marks[r["doc_id"]]]
    good = [r["probability"] for r in got if marks[r["doc_id"]]]
    assert np.mean(good) > 0.9 and np.mean(bad) < 0.3


def test_rules_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{n}.parquet") for n in ("documents", "labels"))
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    aside = labels.where(fold == 0)
    marks = {r["doc_id"]: r["quality"] for r in aside.collect()}
    got = quality_rules.apply_rules(docs, labels.where(fold != 0)).where("NOT base_failed").join(aside.select("doc_id").distinct(), "doc_id").collect()
    good, bad = ([r["kept"] for r in got if marks[r["doc_id"]] == q] for q in (1, 0))
    assert len(good) > 500 and len(bad) > 50
    assert np.mean(good) >= 0.99 and np.mean(bad) <= 0.03


def test_verdicts_with_frozen_weights(docs, rows, tables, spark):
    """Each row's probability from the model's tables by plain loops over its words and code points."""
    model = quality_rules.fit_rules(*tables)
    scorer = quality_rules._scorer(spark.sparkContext.broadcast(model), quality_rules.KEEP_FROM)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    got = {(r["doc_id"], r["n_words"], r["word_chars"]): r for r in texts.mapInArrow(scorer, quality_rules.OUT).collect()}
    for d, t in rows:
        n, chars, *_, failed = base(t)
        raw = (t or "").encode()
        z = model.bias
        for table, (slots, per) in zip(model.tables, quality_rules._families([raw])):
            assert per.sum() == len(slots)
            z += sum(float(table[s]) for s in slots) / max(1, len(slots))
        p = 1 / (1 + np.exp(-np.clip(model.scale * z + model.shift, -35, 35)))
        r = got[d, n, chars]
        assert r["probability"] == pytest.approx(p, abs=1e-5) and r["kept"] == (not failed and r["probability"] >= quality_rules.KEEP_FROM)


def test_machine_on_held_out_rows(tables):
    docs, labels = tables
    marks = {r["doc_id"]: r["quality"] for r in labels.collect()}
    got = factor_machine.score_quality(docs, labels).collect()
    assert len(got) == docs.count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] in marks]
    assert sum(r["predicted"] == marks[r["doc_id"]] for r in held) >= 0.95 * len(held)


def test_machine_edges(docs, rows, none, tables):
    assert factor_machine.score_quality(none, tables[1]).count() == 0
    got = factor_machine.score_quality(docs, tables[1].limit(0)).collect()
    assert len(got) == len(rows) and {round(r["score"], 6) for r in got} == {0.5}


def test_sum_of_squares_identity():
    m = factor_machine.Machine()
    m.w[:] = np.random.default_rng(1).normal(0, 0.1, factor_machine.SIZE)
    slots, values, per = factor_machine.features([b"a b a c", b"", b"one two three"])
    z, _, _ = m.sums(slots, values, per)
    at = 0
    for i, n in enumerate(per):
        s, x = slots[at : at + n], values[at : at + n]
        pairs = sum(float(m.v[s[a]] @ m.v[s[b]]) * x[a] * x[b] for a in range(n) for b in range(a + 1, n))
        assert z[i] == pytest.approx(m.bias + float((m.w[s] * x).sum()) + pairs, abs=1e-4)
        at += n


def test_word_hashes():
    rnd = random.Random(2)
    raws = ["".join(rnd.choice(["ab", "é", " ", "\n", "x"]) for _ in range(rnd.randint(0, 20))).encode() for _ in range(200)]
    h, per = quality.word_hashes(raws)
    assert per.tolist() == [len(r.split()) for r in raws]
    seen = {}
    for w, x in zip([w for r in raws for w in r.split()], h.tolist()):
        assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)
