import random
import re

from pyspark.sql import functions as F

from palimpsest.functions import compression
from palimpsest.operators import graph, patterns
from palimpsest.sources import views

SF = "/root/testdata/sf0.001"


def test_ten_thousand_names_over_all_turns(spark):
    """As ``contains`` for each name and turn, in one automaton or in many."""
    rnd = random.Random(6)
    turns = views.turns(spark, SF).select("id", "content")
    texts = [tuple(r) for r in turns.collect()] + [("none", None), ("empty", ""), ("x", "😀 naïve 😀")]
    pool = " ".join(t for _, t in texts if t)
    names = {pool[i : i + rnd.randint(3, 12)] for i in (rnd.randrange(len(pool)) for _ in range(5000))} | {f"no such {i}" for i in range(5000)} | {"😀", "naïve"}
    df = spark.createDataFrame([(n,) for n in names] + [(None,), ("",)], "name string")
    want = {(i, n) for i, t in texts if t for n in names if n in t}
    every = spark.createDataFrame(texts, "id string, content string")
    for block in (16 << 20, 60_000):
        got = [tuple(r) for r in patterns.found(every, df, block).collect()]
        assert len(got) == len(want) and set(got) == want


def test_phrases_as_in_turn(spark):
    """Overlapping phrases of several lengths and any case, as one replacement after another would have them."""
    rnd = random.Random(2)
    symbols = [("a b", "§1"), ("b c", "§2"), ("a b c", "§3"), ("c a", "§4"), ("bb", "§5"), ("é x", "§6"), ("x$", "§$7")]
    texts = [(i, "".join(rnd.choice(["a", "b", "c", " ", "B", "A", "é", "x", "$", "É"]) for _ in range(60))) for i in range(300)] + [(999, None), (1000, "")]
    df = spark.createDataFrame(texts, "id long, content string")
    got = {r["id"]: r["content"] for r in patterns.replaced(df, spark.createDataFrame(symbols, "phrase string, symbol string")).collect()}
    for i, t in texts:
        want = t
        for phrase, symbol in sorted(symbols, key=lambda s: (-len(s[0]), s[0])):
            want = want and re.sub(re.escape(phrase), lambda m, s=symbol: s, want, flags=re.IGNORECASE | re.ASCII)
        assert got[i] == want
    spec = compression.spec_block([("a b", "§1"), ("b c", "§2")])
    assert spec.split("\n")[4:] == ["SYMBOLS: §1=a b §2=b c", compression.SPEC_USE, *compression.SPEC_TAIL]
    table = spark.createDataFrame([("§2", "b c", 1), ("§1", "a b", 2)], "symbol string, phrase string, value int")
    assert compression.spec_of(table, F.desc("value")).first()["block"] == spec
    assert compression.spec_of(table.where("value > 9"), F.desc("value")).first()["block"] == compression.spec_block([])


def test_seeds_and_walks_of_many_queries(spark):
    """For each query what one query alone has."""
    f = views.graph_facts(spark, SF)
    ents, rels = graph.entities(f).cache(), graph.relations(f).cache()
    queries = {1: "what uses redis here", 2: "Docker and NGINX", 3: "something about svc- and homel", 4: "zzqx", 5: "", 6: "vps1 postgres ubuntu"}
    df = spark.createDataFrame(list(queries.items()), "query_id long, query string")
    start = patterns.seeds(ents, df)
    got, walked = {}, {}
    for r in start.collect():
        got.setdefault(r["query_id"], set()).add(r["name"])
    for r in patterns.walks(start, rels).collect():
        walked.setdefault(r["query_id"], set()).add((r["name"], r["hop"]))
    for i, q in queries.items():
        one = graph.seeds(ents, q)
        assert got.get(i, set()) == {r["name"] for r in one.collect()}
        if i < 4:
            assert walked.get(i, set()) == {tuple(r) for r in graph.walk(one, rels).collect()}


def test_graph_facts_are_dealt_and_grouped_by_hash(spark, monkeypatch):
    """Short rows go to as many tasks as their number asks for; the first step keeps numbers alone and sorts nothing."""
    from palimpsest.operators import graph
    from palimpsest.sources import views

    monkeypatch.setattr(views, "TASK_ROWS", 50, raising=False)
    facts = views.graph_facts(spark, "/root/testdata/sf0.001")
    assert facts.rdd.getNumPartitions() >= facts.count() // 50
    for made in (graph.entities(facts), graph.relations(facts)):
        plan = made._jdf.queryExecution().sparkPlan().toString()
        lowest = [line for line in plan.splitlines() if "Aggregate(" in line][-1]
        assert "HashAggregate" in lowest and "SortAggregate" not in lowest
