"""Phrases mined level by level, and walks over a stored table of neighbours."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from palimpsest.functions.text import PHRASE_STOP_WORDS
from palimpsest.operators import adjacency, phrase_levels, phrases


def counted(turns, longest=6, least_freq=2, least_convs=1):
    """phrase -> (freq, conversations) by plain loops."""
    convs, freq, held = {}, Counter(), {}
    for c, _, text in sorted(turns, key=lambda t: t[:2]):
        convs.setdefault(c, []).append(text)
    for c, texts in convs.items():
        if len(" ".join(texts)) < 10:
            continue
        words = [w for w in " ".join(texts).lower().split() if len(w) > 1]
        for n in range(2, longest + 1):
            for i in range(len(words) - n + 1):
                gram = words[i : i + n]
                if gram[0] in PHRASE_STOP_WORDS or gram[-1] in PHRASE_STOP_WORDS or len(" ".join(gram)) < 6:
                    continue
                freq[" ".join(gram)] += 1
                held.setdefault(" ".join(gram), set()).add(c)
    return sorted((p, n, len(held[p])) for p, n in freq.items() if n >= least_freq and len(held[p]) >= least_convs)


@pytest.fixture(scope="module")
def turns():
    rnd = random.Random(3)
    words = ["the", "of", "and", "alpha", "beta", "gamma", "delta", "x", "it", *(f"w{i}" for i in range(300))]
    rows = [(c, t, " ".join(rnd.choice(words[: rnd.choice((9, 309))]) for _ in range(rnd.randint(0, 30)))) for c in range(12) for t in range(6)]
    # one conversation holds a third of all, of one phrase again and again
    return rows + [(99, t, "alpha beta of gamma delta " * 12) for t in range(36)]


@pytest.mark.parametrize("slots", [None, 64])  # a table of 64 slots lets nearly everything through
def test_mined_phrases(spark, turns, slots):
    df = spark.createDataFrame(turns, "conv_id long, turn long, content string")
    got = phrase_levels.mined_phrases(df, slots=slots)
    assert sorted(tuple(r) for r in got.collect()) == counted(turns)


def test_thresholds_and_edges(spark, turns):
    df = spark.createDataFrame([*turns, (None, 1, "a phrase of no conversation, a phrase of none"), (5, None, None)], "conv_id long, turn long, content string")
    got = phrase_levels.mined_phrases(df.where("conv_id IS NOT NULL AND content IS NOT NULL"), longest=4, least_freq=5, least_convs=2)
    assert sorted(tuple(r) for r in got.collect()) == counted(turns, 4, 5, 2)
    assert phrase_levels.mined_phrases(df).count() >= len(counted(turns))
    assert phrase_levels.mined_phrases(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        phrase_levels.mined_phrases(df, slots=100)


def reached(edges, starts, hops):
    near, out = {}, []
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    for s in starts:
        seen, front = {s: 0}, [s]
        for hop in range(1, hops + 1):
            front = sorted({b for a in front for b in near.get(a, ())} - set(seen))
            seen |= dict.fromkeys(front, hop)
        out += [(s, n, h) for n, h in seen.items()]
    return sorted(out)


def test_walks(spark):
    rnd = random.Random(5)
    edges = [("hub", f"n{i}") for i in range(300)] + [(f"n{rnd.randrange(300)}", f"m{rnd.randrange(200)}") for _ in range(150)] + [("m1", "m1"), ("z1", "z2")]
    weak = [("n1", "far"), ("z2", "n3")]
    rows = [(a, b, 0.8) for a, b in edges] + [(b, a, 0.6) for a, b in edges[:40]] + [(a, b, 0.2) for a, b in weak] + [(None, "n1", 0.9), ("n2", None, 0.9), ("n4", "none", None)]
    near = adjacency.stored_adjacency(spark.createDataFrame(rows, "from string, to string, confidence double"), most=20, buckets=8)
    assert near.hubs.where("name = 'hub'").first()["parts"] == 15
    starts = ["n5", "m1", "z1", "nowhere", "hub"]
    df = spark.createDataFrame([(s, s) for s in [*starts, "m1"]] + [("m1", None)], "seed string, name string")
    for hops in (0, 1, 3, 6):
        assert sorted(tuple(r) for r in adjacency.walked(near, df, hops, by=["seed"]).collect()) == reached(edges, starts, hops)
    # weak edges count once they are asked for
    assert ("far" in {r["name"] for r in adjacency.walked(near, df.select("name"), 3, least=0.1).collect()}) is True
    assert adjacency.walked(near, df.limit(0), 2, by=["seed"]).count() == 0
    near.forget()
    none = adjacency.stored_adjacency(spark.createDataFrame([], "from string, to string, confidence double"))
    assert [tuple(r) for r in adjacency.walked(none, df.where("seed = 'hub'"), 2, by=["seed"]).collect()] == [("hub", "hub", 0)]


def test_a_hub_in_parts(spark):
    n = 1_000_000
    rels = spark.range(n).select(F.lit("hub").alias("from"), F.concat(F.lit("n"), "id").alias("to"), F.lit(1.0).alias("confidence"))
    near = adjacency.stored_adjacency(rels, most=5_000, buckets=8)
    rows = near.edges.where("name = 'hub'").groupBy("part").count().collect()
    assert len(rows) == n // 5_000 and max(r["count"] for r in rows) < 2 * 5_000
    # files are buckets: none holds over twice the median of the edges
    sizes = sorted(r["count"] for r in near.edges.groupBy(F.input_file_name()).count().collect())
    assert len(sizes) == 8 and sizes[-1] <= 2 * sizes[4]
    front = spark.range(3).select(F.concat(F.lit("n"), "id").alias("name"), F.col("id").cast("int").alias("part")).hint("merge")
    plan = front.join(near.edges, ["name", "part"])._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and plan.count("Exchange") == 1  # the front's, not the edges'
    assert adjacency.walked(near, spark.createDataFrame([("n7",)], "name string"), 2).count() == n + 1
    near.forget()


def test_parts_of_words_follow_the_characters(spark, monkeypatch):
    """Words are dealt to as many tasks as their characters ask for, and Spark puts none of them together."""
    monkeypatch.setattr(phrases, "TASK_CHARS", 500, raising=False)
    df = spark.createDataFrame([(c, t, f"the same words of turn {t} in a conversation {c}") for c in range(40) for t in range(6)], "conv_id long, turn int, content string")
    chars = df.selectExpr("sum(length(content)) AS n").first()["n"]
    assert phrases.word_rows(df, 6).rdd.getNumPartitions() == 1 + chars // 500
    assert sorted(phrase_levels.mined_phrases(df, slots=64).collect()) == sorted(phrases.phrase_counts(df).collect())
    assert sorted(phrase_levels.mined_phrases(df, 3, 4, 3).collect()) == sorted(phrases.phrase_counts(df, 3, 4, 3).collect())


def test_each_level_is_looked_up_once(spark):
    df = spark.createDataFrame([(1, 0, "words of a turn that recur and words of a turn that recur")], "conv_id long, turn int, content string")
    plan = phrase_levels.mined_phrases(df)._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < plan.count("getbit(") <= 5
