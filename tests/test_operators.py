import random

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import compression, text
from palimpsest.operators import conversation, facts, graph, phrases, retrieval, tables, windows
from palimpsest.sources import history, views

SF = "/root/testdata/sf0.001"


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x"))).first()[0]


def test_tokenizers(spark):
    assert one(spark, text.retrieval_tokens, "The Redis_1 server-x is é up! a 42") == ["redis_1", "server-x", "42"]
    assert one(spark, text.relevance_tokens, "The Redis_1 is up!") == ["the", "redis"]
    assert one(spark, text.retrieval_tokens, None) == []
    assert retrieval.query_terms("The Redis_1 server-x is é up! a 42") == ["redis_1", "server-x", "42"]


def test_small_functions(spark):
    assert one(spark, lambda x: text.truncated(x, 5), "abcdef") == "ab..."
    assert [one(spark, text.normal_role, r) for r in ("HUMAN", "bot", None, "System")] == ["user", "assistant", "assistant", "system"]
    assert [one(spark, text.short_number, n, "long") for n in (999, 1250, 2_500_000)] == ["999", "1.3K", "2.5M"]
    assert [one(spark, text.cost_label, c, "double") for c in (0.0001, 0.25)] == ["<$0.01", "$0.250"]
    assert one(spark, text.last_sentences, "--- a. ---One. Two! Three?") == "Two! Three?"
    assert one(spark, text.without_context, "<memory_context>\nx\n</memory_context>\n\nhello") == "hello"


def test_bm25_by_hand(spark):
    docs = spark.createDataFrame([("a", "redis redis cache server"), ("b", "redis server with nothing else here"), ("c", "a wholly different subject")], "id string, content string")
    got = {r["id"]: r["score"] for r in retrieval.bm25(docs, ["redis", "redis"], 5).collect()}
    import math

    lengths = {"a": 4, "b": 4, "c": 3}
    avg = sum(lengths.values()) / 3
    idf = math.log((3 - 2 + 0.5) / 2.5 + 1)
    score = lambda tf, dl: 2 * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avg))
    assert got == {"a": pytest.approx(score(2, 4), abs=1e-6), "b": pytest.approx(score(1, 4), abs=1e-6)}


def test_rrf_does_not_depend_on_row_order(spark):
    a = [("x", 1), ("y", 2), ("z", 3)]
    b = [("z", 1), ("w", 2)]
    want = None
    for seed in range(3):
        random.Random(seed).shuffle(a)
        got = [tuple(r) for r in retrieval.rrf([spark.createDataFrame(a, "id string, rank int"), spark.createDataFrame(b, "id string, rank int")], 4).collect()]
        want = want or got
        assert got == want
    assert [r[0] for r in want] == ["z", "x", "y", "w"]


def echoes(rows, window=5000, back=5):
    kept = []
    for r in sorted(rows, key=lambda r: r[1]):
        if any(k[3] == r[3] and k[4] == r[4] and abs(k[5] - r[5]) < window for k in kept[-back:]):
            continue
        kept.append(r)
        kept.sort(key=lambda k: (k[5], k[1]))
    return kept


def test_echoes_against_a_loop(spark):
    rnd = random.Random(4)
    rows = [(c, a, f"{c}-{a}", rnd.choice(["user", "assistant"]), rnd.choice("pqr"), rnd.randint(0, 30) * 1000) for c in range(12) for a in range(25)]
    df = spark.createDataFrame(rows, "conv_id long, arrival long, id string, role string, content string, ts_ms long")
    once = conversation.without_echoes(df)
    assert {r["id"] for r in once.collect()} == {r[2] for c in range(12) for r in echoes([x for x in rows if x[0] == c])}


def test_fuzzy_facts_against_a_loop(spark):
    rnd = random.Random(1)
    words = ["word%d" % i for i in range(40)]
    base = [rnd.sample(words, 12) for _ in range(6)]
    texts = [" ".join(w if rnd.random() > 0.06 else rnd.choice(words) for w in rnd.choice(base)) for _ in range(60)] + ["", "a b"]
    sets = [{w for w in t.lower().split() if len(w) > 2} for t in texts]
    sim = lambda a, b: len(a & b) / max(len(a), len(b)) if a and b else 0
    first = {}
    for i, s in enumerate(sets):
        first.setdefault(frozenset(s), i)
    ids = sorted(first.values())
    want = {(a, b) for a in ids for b in ids if a < b and round(sim(sets[a], sets[b]), 6) >= 0.85}
    df = spark.createDataFrame(list(enumerate(texts)), "id long, content string")
    pairs = facts.similar_pairs(df)
    assert {(r["a"], r["b"]) for r in pairs.collect()} == want
    kept = []
    for i in ids:
        if not any((k, i) in want for k in kept):
            kept.append(i)
    got = facts.accepted(spark.createDataFrame([(i,) for i in ids], "id long"), pairs)
    assert sorted(r["id"] for r in got.collect()) == kept


def members(texts, least=0.85):
    """The loop: {id: the kept fact that stands for it}."""
    kept, out = [], {}
    for i, t in sorted(texts):
        w = {x for x in t.lower().split() if len(x) > 2}
        alike = [k for k, (u, v) in kept if u == t.lower() or (w and v and round(len(w & v) / max(len(w), len(v)), 6) >= least)]
        if not alike:
            kept.append((i, (t.lower(), w)))
        out[i] = alike[0] if alike else i
    return out


@pytest.mark.parametrize("few,growth,most", [(12, 3, 0), (256, 16, 50)])
def test_members_against_the_loop(spark, few, growth, most):
    """Dense groups and chains, settled by representatives in batches of any size."""
    rnd = random.Random(few)
    pool = ["word%d" % i for i in range(60)]
    base = [rnd.sample(pool, 12) for _ in range(3)]
    texts = []
    for i in range(90):
        w = list(base[i % 3 if i < 60 else 2])
        for _ in range(rnd.choice([0, 1, 1, 2])):
            w[rnd.randrange(12)] = rnd.choice(pool) if rnd.random() < 0.7 else f"own{i}"
        texts.append((i * 3, " ".join(rnd.sample(w, 12)).replace("word1 ", "Word1 ")))
    texts += [(500, ""), (501, "a b"), (502, "A b"), (503, texts[4][1]), (504, "a b c")]
    df = spark.createDataFrame(texts, "id long, content string")
    got = {r["id"]: r["representative"] for r in facts.fuzzy_members(df, few=few, growth=growth, most=most).collect()}
    assert got == members(texts)


def test_near_copies_make_a_row_each(spark, monkeypatch):
    """Of some thousand near copies no table on the way has more than a few rows for each."""
    made, write = [], facts.materialised
    monkeypatch.setattr(facts, "materialised", lambda df: made.append(write(df)) or made[-1])
    words = [f"word{i}" for i in range(20)]
    texts = [(i, " ".join([*words[: i % 20], f"own{i}", *words[i % 20 + 1 :]])) for i in range(6000)]
    out = facts.fuzzy_members(spark.createDataFrame(texts, "id long, content string"))
    assert {r["representative"] for r in out.collect()} == {0}
    assert max(df.count() for df in made) <= 8 * len(texts)


def greedy(rows, budget=80):
    left, out = budget, []
    for phrase, freq, tokens, value in sorted(rows, key=lambda r: (-r[3], r[0])):
        if tokens + 3 <= left:
            left -= tokens + 3
            out.append(phrase)
    return out


def test_dictionary_against_the_whole_pass(spark):
    found = phrases.candidates(phrases.phrase_counts(views.turns(spark, SF)))
    rows = [(r["phrase"], r["freq"], r["tokens"], r["value"]) for r in found.collect()]
    got = phrases.dictionary(found).collect()
    assert [r["phrase"] for r in got] == greedy(rows)
    assert len({r["symbol"] for r in got}) == len(got) and sum(r["spec_cost"] for r in got) <= 80


def test_symbols():
    used = set()
    for want in ("§abc", "§ale", "§alb", "§1"):
        s = phrases.symbol_for("alert big cat", used)
        used.add(s)
        assert s == want


def test_compress_and_expand(spark):
    symbols = [("knowledge graph", "§kg"), ("vector store", "§vs")]
    df = spark.createDataFrame([("the knowledge graph and the vector store, a knowledge graph.",), ("short",)], "x string")
    back = [r[0] for r in df.select(compression.expanded(compression.compressed(F.col("x"), symbols), symbols)).collect()]
    assert back == [r[0] for r in df.collect()]
    long = "In order to test this, I would recommend the implementation basically , ok"
    assert one(spark, compression.compressed, long) == "to test this, I recommend the impl ok"


def test_graph(spark):
    f = spark.createDataFrame([(1, "BillingGateway uses Redis on vps1", 10), (2, "BillingGateway uses redis", 20), (3, "nothing here", 30), (4, "version v1.2.3 and 1.2.3 on port 8080", 40)], "id long, content string, ts_ms long")
    ents = {r["name"]: r for r in graph.entities(f).collect()}
    assert ents["redis"]["mentions"] == 4 and ents["redis"]["type"] == "tool" and ents["billinggateway"]["type"] == "project"
    rels = {(r["from"], r["to"], r["rel"]): r for r in graph.relations(f).collect()}
    uses = rels["redis", "redis", "USES"]  # tools come before projects, so the first entity is redis
    assert uses["confidence"] == pytest.approx(0.8) and uses["n"] == 2
    seen = graph.walk(graph.seeds(graph.entities(f), "about redis"), graph.relations(f))
    assert {r["name"] for r in seen.collect()} >= {"redis"}
    block = graph.block(seen, graph.entities(f), graph.relations(f)).first()[0]
    assert block.startswith("[KNOWLEDGE GRAPH]\nTOOL: Redis (seen 4x)")


def test_tables(spark, tmp_path):
    t = spark.createDataFrame([("k", 1, "old"), ("k", 2, "new"), ("j", 1, "x")], "key string, v int, content string")
    assert {(r["key"], r["content"]) for r in tables.upsert(t, "key", "v").collect()} == {("k", "new"), ("j", "x")}
    assert tables.setting(spark.createDataFrame([("a", "1")], "key string, value string"), "b", "z").first()[0] == "z"
    turns = views.turns(spark, SF)
    tables.export_json(turns, str(tmp_path / "x"))
    again = tables.import_json(spark, str(tmp_path / "x")).select(*turns.columns)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, turns.collect()))
    docs = spark.createDataFrame([(i, i) for i in range(30)], "id long, ts_ms long")
    assert tables.evict(docs, 25, 10).count() == 30 and sorted(r["id"] for r in tables.evict(docs, 20, 10).collect()) == list(range(10, 30))


def test_history(spark, tmp_path):
    import json

    (tmp_path / "page-0.json").write_text(json.dumps([{"id": i} for i in range(3)]))
    (tmp_path / "page-1.json").write_text("{broken")
    (tmp_path / "page-2.json").write_text(json.dumps([{"id": 9}]))
    (tmp_path / "page-10.json").write_text(json.dumps([{"id": 10}]))
    rows = history.page_items(history.read_pages(spark, str(tmp_path)), 3).collect()
    assert sorted((r["page"], r["at"], r["item"]) for r in rows if r["item"]) == [(0, 0, '{"id":0}'), (0, 1, '{"id":1}'), (0, 2, '{"id":2}'), (2, 0, '{"id":9}')]
    assert [r["page"] for r in rows if r["error"]] == [1]


def test_import_without_export(spark, tmp_path):
    with pytest.raises(ValueError, match="Invalid export format"):
        tables.import_all(spark, str(tmp_path / "nothing"), {"facts": "key string"})


def test_export(spark, tmp_path):
    path = str(tmp_path / "export")
    log = spark.range(250).select(F.concat(F.lit("sync_"), "id").alias("id"), (F.col("id") % 240).alias("timestamp"))
    facts = spark.createDataFrame([("a", 1.0), ("b", None)], "id string, confidence double")
    tables.export_all(path, 1, "2024-01-01", syncLog=log, facts=facts)
    kinds = {"syncLog": "id string, timestamp long", "facts": "id string, confidence double", "settings": "key string"}
    back = tables.import_all(spark, path, kinds)
    assert sorted(r["timestamp"] for r in back["syncLog"].collect()) == list(range(140, 240))
    assert sorted(tuple(r) for r in back["facts"].collect()) == [("a", 1.0), ("b", None)] and back["settings"].count() == 0
    # an export that dies on its way changes nothing
    with pytest.raises(Exception, match="stopped"):
        tables.export_all(path, 2, "2024-01-02", facts=facts.limit(1), syncLog=log.withColumn("timestamp", F.raise_error(F.lit("stopped")).cast("long")))
    assert tables.import_all(spark, path, kinds)["facts"].count() == 2
    tables.export_all(path, 3, "2024-01-03", facts=facts.limit(0))
    assert [df.count() for df in tables.import_all(spark, path, kinds).values()] == [0, 0, 0]
    with pytest.raises(ValueError, match="no part"):
        tables.export_all(path, 1, "2024-01-01", other=facts)


def test_vector_search_in_blocks(spark):
    """Blocks of any size, queries of several lengths, vectors without length."""
    rnd = random.Random(7)
    vec = lambda n: [rnd.gauss(0, 1) for _ in range(n)]
    rows = [(i, vec(8), i % 3) for i in range(60)] + [(60, [0.0] * 8, 0), (61, vec(5), 1), (62, None, 1), (63, [], 1)]
    vectors = spark.createDataFrame(rows, "id long, vector array<double>, model int")
    asked = [(i, v, m) for i, v, m in rows if v and i % 5 < 2]
    queries = spark.createDataFrame(asked, "query_id long, query array<double>, query_model int")

    def cos(a, b):
        if not b or len(a) != len(b) or not any(a) or not any(b):
            return 0.0
        return round(sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) * sum(y * y for y in b)) ** 0.5, 4)

    for same in (False, True):
        want = set()
        for q, a, m in asked:
            best = sorted((-cos(a, b), i) for i, b, n in rows if cos(a, b) > 0.2 and (m == n or not same))[:4]
            want |= {(q, i, -s, k + 1) for k, (s, i) in enumerate(best)}
        got = retrieval.vector_search(vectors, queries, 0.2, 4, same_model=same, query_rows=7, vector_rows=9)
        assert {(r["query_id"], r["id"], r["score"], r["rank"]) for r in got.collect()} == want


def test_chain_of_dependent_pairs(spark):
    """A chain settles whatever its length: every other id stays."""
    pairs = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 50)], "a long, b long")
    ids = spark.createDataFrame([(i,) for i in [*range(301), *range(1000, 1050), 5000]], "id long")
    assert sorted(r["id"] for r in facts.accepted(ids, pairs).collect()) == [*range(0, 301, 2), 1000, 5000]


def test_equal_short_facts(spark):
    df = spark.createDataFrame([(1, "a b"), (2, "A b"), (3, "c"), (4, "some longer words"), (5, "words longer some")], "id long, content string")
    assert sorted(r["id"] for r in facts.fuzzy_distinct(df).collect()) == [1, 3, 4]


def test_context_blocks(spark):
    rows = spark.createDataFrame([(1, None, ""), (2, "s", None), (3, "s", "r\n$1")], "n int, session string, relevant string")
    got = {r["n"]: r["block"] for r in rows.select("n", retrieval.context_blocks(F.col("session"), F.col("relevant"), "host").alias("block")).collect()}
    session = f"--- HOST SESSION CONTEXT ---\n{retrieval.SESSION_NOTE}\ns\n--- END SESSION CONTEXT ---\n"
    assert got == {1: None, 2: session + "\n", 3: f"{session}--- HOST RELEVANT CONTEXT ---\n{retrieval.RELEVANT_NOTE}\nr\n$1\n--- END RELEVANT CONTEXT ---\n\n"}


def test_hashed_embedding(spark):
    df = spark.createDataFrame([(1, "redis server cache"), (2, "cache server redis"), (3, "")], "id long, content string")
    v = {r["id"]: r["vector"] for r in retrieval.embedded(df, retrieval.hashed_embedding).collect()}
    assert v[1] == v[2] and len(v[1]) == 64 and sum(x * x for x in v[1]) == pytest.approx(1) and not any(v[3])


def test_as_of(spark):
    left = spark.createDataFrame([(1, 5, "a"), (1, 1, "b"), (2, 9, "c")], "k int, at int, n string")
    right = spark.createDataFrame([(1, 3, 30.0), (1, 5, 50.0), (2, 10, 1.0)], "k int, at int, v double")
    assert {(r["n"], r["v"]) for r in windows.as_of(left, right, "k", "at", "v").collect()} == {("a", 50.0), ("b", None), ("c", None)}


def test_similar_pairs_send_words_once(spark):
    """Dense groups, short sets and words that all have, against a loop; no pair carries the words of its sets."""
    rnd = random.Random(3)
    pool = ["word%d" % i for i in range(400)]
    base = [rnd.sample(pool, 30) for _ in range(4)]
    texts = []
    for i in range(240):
        w = ["everyone", *base[i % 4]]
        for _ in range(rnd.choice([0, 1, 2, 3])):
            w[rnd.randrange(31)] = rnd.choice(pool) if rnd.random() < 0.8 else f"own{i}"
        texts.append(" ".join(w))
    texts += [" ".join(rnd.sample(pool[:8], n)) for n in (1, 1, 2, 2, 3, 3, 6, 7, 7, 8)] + [None, "", "everyone"]
    sets = [{w for w in (t or "").split() if len(w) > 2} for t in texts]
    ids = sorted({frozenset(s): i for i, s in reversed(list(enumerate(sets))) if s}.values())
    near = {(a, b): round(len(sets[a] & sets[b]) / max(len(sets[a]), len(sets[b])), 6) for a in ids for b in ids if a < b}
    pairs = facts.similar_pairs(spark.createDataFrame(list(enumerate(texts)), "id long, content string"))
    assert {(r["a"], r["b"]): r["similarity"] for r in pairs.collect()} == {x: s for x, s in near.items() if s >= 0.85}
    assert "array_intersect" not in pairs._jdf.queryExecution().executedPlan().toString()


def test_large_cells_are_dealt_in_parts(spark, monkeypatch):
    monkeypatch.setattr(facts, "CELL", 7)
    words = [f"word{i}" for i in range(20)]
    texts = [(i, " ".join([*words[: i % 20], f"own{i}", *words[i % 20 + 1 :]])) for i in range(60)]
    pairs = facts.similar_pairs(spark.createDataFrame(texts, "id long, content string"))
    assert pairs.count() == sum(1 for a in range(60) for b in range(a) if len({*texts[a][1].split()} & {*texts[b][1].split()}) >= 17)


def test_few_pairs_are_settled_at_once(spark, monkeypatch):
    """Sets that share rare words but are of other lengths need no batches."""
    made, write = [], facts.materialised
    monkeypatch.setattr(facts, "materialised", lambda df: made.append(write(df)) or made[-1])
    texts = [(i, " ".join(["shared", *[f"w{(7 * i + k * k) % 900}" for k in range(2 + i % 60)]])) for i in range(1200)]
    out = facts.fuzzy_members(spark.createDataFrame(texts, "id long, content string"), most=5)
    assert {r["id"]: r["representative"] for r in out.collect()} == members(texts)
    assert len(made) <= 12
