"""The library's queries by name, each over whole tables."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.engine import Engine
from palimpsest.functions import compression, text, values
from palimpsest.operators import adjacency, conversation, facts, graph, patterns, phrase_levels, phrases, retrieval, tables, telemetry, windows
from palimpsest.operators.keyed import KeyedTable
from palimpsest.operators.search_index import SearchIndex
from palimpsest.plans.kept import kept, turn_index
from palimpsest.plans.steps import materialised, shared_path
from palimpsest.sources import history, sse, views
from palimpsest.streaming.rollups import Conversations

TERMS = ["thing", "thtion", "ernt", "thing"]
AS_OF_MS = views.EPOCH_MS + 600_000 * 1000
SYMBOLS = [("that the", "§tt"), ("with the", "§wt"), ("tion", "§ti")]


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.col("label").alias("model"))


def _query_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors to search for: those whose ids are divisible by 100."""
    return _vectors(spark, sf_dir).where(F.col("id") % 100 == 0).select(F.col("id").alias("query_id"), F.col("vector").alias("query"), F.col("model").alias("query_model"))


def _rollup(spark, sf_dir):
    return conversation.rollup(views.turns(spark, sf_dir))


def _synced(spark, sf_dir):
    """When conversations were last synced: half an hour in, those of odd ids; two of three of the rest at the end."""
    r = _rollup(spark, sf_dir)
    at = F.when(F.col("conv_id") % 2 == 1, F.col("started_at") + 120_000).when(F.col("conv_id") % 3 != 0, F.col("updated_at"))
    return r.select("conv_id", at.alias("synced_at")).where("synced_at IS NOT NULL")


def bm25_topk(spark, sf_dir):
    """The best turns, from the index that is kept of them."""
    return turn_index(spark, sf_dir).bm25(TERMS, 16)


def bm25_scan(spark, sf_dir):
    """The same by a scan of all turns, without an index."""
    return retrieval.bm25(views.turns(spark, sf_dir), TERMS, 16)


def bm25_terms(spark, sf_dir):
    return retrieval.index_terms(views.turns(spark, sf_dir))


def bm25_stats(spark, sf_dir):
    return retrieval.index_stats(views.turns(spark, sf_dir))


def index_changes(spark, sf_dir):
    """The best turns after turns were added to an index, some were replaced, and some removed."""
    turns = views.turns(spark, sf_dir)
    index = SearchIndex.create(spark, shared_path(spark, "index")).add(turns.where("conv_id % 2 = 0"), new=True)
    index = index.add(turns.where("turn < 2").withColumn("content", F.concat("content", F.lit(" thing thing"))))
    return index.remove(turns.where("conv_id % 5 = 0").select("id")).bm25(TERMS, 20)


def vector_topk(spark, sf_dir):
    return retrieval.vector_search(_vectors(spark, sf_dir), _query_vectors(spark, sf_dir))


def vector_same_model(spark, sf_dir):
    return retrieval.vector_search(_vectors(spark, sf_dir), _query_vectors(spark, sf_dir), 0.3, 5, strict=False, same_model=True)


def vector_normalised(spark, sf_dir):
    doubled = F.transform("vector", lambda x: x.cast("double") * 2)
    v = _vectors(spark, sf_dir).select("id", retrieval.normalised(doubled).alias("v"))
    return v.select("id", F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x), 6).alias("norm2"), F.round(F.element_at("v", 1), 6).alias("first"))


def rrf_hybrid(spark, sf_dir):
    """For each vector searched for, its neighbours fused with the best turns by keywords."""
    asked = _query_vectors(spark, sf_dir)
    words = retrieval.ranked(turn_index(spark, sf_dir).bm25(TERMS, 16)).join(asked.select("query_id"))  # 16 rows for each query
    near = retrieval.vector_search(_vectors(spark, sf_dir), asked)
    near = near.select("query_id", F.expr("concat(id DIV 6, '-', id % 6)").alias("id"), "rank")
    return retrieval.rrf([words, near], 8, by="query_id")


def recent_turns(spark, sf_dir):
    return retrieval.recent(views.turns(spark, sf_dir), 6)


def layered_retrieval(spark, sf_dir):
    """Four queries, one for each layer that can answer."""
    turns, known = views.turns(spark, sf_dir), views.facts(spark, sf_dir)
    tied = functools.cache(lambda: _graph(spark, sf_dir))  # made once, and only if a query gets so far
    out = None
    for query in ("hi", "thing thtion", "zzqx redis", "zzqx zzqy"):
        rows = retrieval.layered(query, turns, lambda q=query: graph.layer(*tied(), q), known, search=turn_index(spark, sf_dir).bm25).withColumn("query", F.lit(query))
        out = rows if out is None else out.unionByName(rows)
    return out.select("query", "layer", "id", F.round("score", 6).alias("score"), "method")


def fact_relevance(spark, sf_dir):
    return retrieval.relevant_facts(views.facts(spark, sf_dir), "that the thing with thtion from ernt and this", AS_OF_MS, 0.2)


def facts_by_confidence(spark, sf_dir):
    return retrieval.facts_by_confidence(views.facts(spark, sf_dir)).select("id", "confidence", "ts_ms")


def conversation_rollup(spark, sf_dir):
    return _rollup(spark, sf_dir)


def conversation_stats(spark, sf_dir):
    return conversation.stats(_rollup(spark, sf_dir), _synced(spark, sf_dir))


def platform_breakdown(spark, sf_dir):
    return conversation.by_platform(views.turns(spark, sf_dir))


def conversations_recent(spark, sf_dir):
    return conversation.conversations(_rollup(spark, sf_dir), 20, since_ms=views.EPOCH_MS + 3_600_000, platform="claude").select("conv_id", "updated_at")


def conversations_cursor(spark, sf_dir):
    return conversation.conversations(_rollup(spark, sf_dir), 20, since_ms=views.EPOCH_MS, mode="cursor").select("conv_id", "updated_at")


def conversations_changed(spark, sf_dir):
    return conversation.changed_since(_rollup(spark, sf_dir), views.EPOCH_MS + 36_000_000).select("conv_id", "updated_at")


def popup_rows(spark, sf_dir):
    return conversation.popup_rows(_rollup(spark, sf_dir), _synced(spark, sf_dir))


def role_normalise(spark, sf_dir):
    spelt = F.when(F.col("turn") % 3 == 0, F.upper("role")).when(F.col("turn") % 3 == 1, F.lit("Human")).when(F.col("turn") == 2, F.lit(None).cast("string")).otherwise(F.lit("model"))
    return views.turns(spark, sf_dir).select(text.normal_role(spelt).alias("role")).groupBy("role").agg(F.count("*").alias("n"))


def content_normalise(spark, sf_dir):
    t = views.turns(spark, sf_dir)
    blocks = F.to_json(F.array(F.struct(F.lit("text").alias("type"), F.col("content").alias("text")), F.struct(F.lit("text").alias("type"), F.lit("  ").alias("text")), F.struct(F.lit("text").alias("type"), F.lit("end").alias("text"))))
    mixed = t.select("id", F.when(F.col("turn") % 2 == 0, blocks).otherwise(F.concat(F.lit(" \n "), "content")).alias("content"))
    return values.with_content(mixed, "content")


def _shaped(spark, sf_dir):
    """Turns with contents as services send them: texts, arrays of texts and blocks, objects, numbers and broken JSON."""
    t, at = views.turns(spark, sf_dir), F.pmod(F.col("conv_id") + F.col("turn"), F.lit(7))
    quoted = F.to_json(F.struct(F.col("content").alias("c")))
    quoted = F.substring(quoted, F.lit(6), F.length(quoted) - 6)  # the JSON string alone
    made = (
        F.when(at == 0, quoted)
        .when(at == 1, F.concat(F.lit('["one", {"type": "text", "text": '), quoted, F.lit('}, {"type": "image"}, {"text": ""}, null, 7]')))
        .when(at == 2, F.concat(F.lit('{"b": {"c": [1, 2]}, "a": '), quoted, F.lit("}")))
        .when(at == 3, F.col("turn").cast("string"))
        .when(at == 4, F.lit("null"))
        .when(at == 5, F.concat(F.lit('{"a": '), quoted))
        .otherwise(F.concat(F.lit("[["), quoted, F.lit("], false, []]")))
    )
    return t.select("id", "platform", made.alias("body"))


def content_shapes(spark, sf_dir):
    """Kind and text of each content; a body that is no JSON has no kind and an empty text."""
    v = F.col("json")
    return values.parsed(_shaped(spark, sf_dir), "body").select("id", values.kind(v).alias("kind"), values.content_text(v).alias("content"))


def content_schemas(spark, sf_dir):
    """The schema that fits all JSON objects that each service sends."""
    rows = values.parsed(_shaped(spark, sf_dir), "body")
    return values.shapes(rows.where(values.kind(F.col("json")) == "OBJECT"), F.col("json"), "platform")


def turn_dedup(spark, sf_dir):
    return conversation.without_echoes(conversation.first_by_id(views.turns_with_copies(spark, sf_dir))).select("conv_id", "id", "arrival", "ts_ms")


def fact_similar_pairs(spark, sf_dir):
    return facts.similar_pairs(views.facts(spark, sf_dir))


def fact_fuzzy_dedup(spark, sf_dir):
    """Facts kept by the pass in id order."""
    return facts.fuzzy_distinct(views.facts(spark, sf_dir))


def fact_members(spark, sf_dir):
    """Each fact with the kept one that stands for it."""
    return facts.fuzzy_members(views.facts(spark, sf_dir))


def fact_search(spark, sf_dir):
    return facts.search(views.facts(spark, sf_dir), "THTION").select("id", "category")


def fact_valid(spark, sf_dir):
    raw = views.facts(spark, sf_dir).select("id", "content", F.when(F.col("id") % 4 > 0, F.col("category")).alias("category"), F.when(F.col("id") % 5 > 0, F.upper("confidence")).otherwise("sure").alias("confidence"))
    return facts.valid(raw).groupBy("category", "confidence").agg(F.count("*").alias("n"))


def fact_answers(spark, sf_dir):
    """Facts parsed back from fenced JSON answers."""
    listed = F.to_json(F.array(F.struct("content", "category", "confidence")))
    answers = views.facts(spark, sf_dir).select("id", F.concat(F.lit("```json\n"), listed, F.lit("\n```")).alias("answer"))
    return answers.select("id", F.inline(facts.parsed_answer(F.col("answer"))))


def ngram_counts(spark, sf_dir):
    return phrases.phrase_counts(views.turns(spark, sf_dir))


def phrases_mined(spark, sf_dir):
    """``ngram_counts`` level by level: only what may recur is exchanged as text."""
    return phrase_levels.mined_phrases(views.turns(spark, sf_dir))


def symbol_candidates(spark, sf_dir):
    return phrases.candidates(phrases.phrase_counts(views.turns(spark, sf_dir)))


def symbol_dictionary(spark, sf_dir):
    return phrases.dictionary(phrases.candidates(phrases.phrase_counts(views.turns(spark, sf_dir))))


def _wordy(spark, sf_dir):
    """Turns with phrases that the rules know around their text."""
    lead = F.element_at(F.array(*[F.lit(x) for x in ("In order to ", "Basically, ", "It's worth noting that ", "")]), (F.col("turn") % 4 + 1).cast("int"))
    return views.turns(spark, sf_dir).select("id", F.concat(lead, "content", F.lit(" as well as the documentation , for example. Hope this helps")).alias("content"))


def compress_static(spark, sf_dir):
    return _wordy(spark, sf_dir).select("id", compression.compressed(F.col("content")).alias("short"))


def compress_dictionary(spark, sf_dir):
    return _wordy(spark, sf_dir).select("id", compression.compressed(F.col("content"), SYMBOLS).alias("short"))


def compression_savings(spark, sf_dir):
    rows = _wordy(spark, sf_dir).select(F.length("content").alias("raw"), F.length(compression.compressed(F.col("content"))).alias("short"))
    saved = F.greatest(F.lit(0).cast("long"), text.token_estimate(F.col("raw") - F.col("short")))
    spec = len(compression.spec_block(SYMBOLS)) // 4 + 1
    rows = rows.select(text.token_estimate(F.col("raw")).alias("raw"), saved.alias("saved"))
    return rows.agg(
        F.sum("raw").alias("raw_tokens"), F.sum("saved").alias("gross_saved"), (F.sum("saved") - spec * F.count("*")).alias("net_saved"), text.percent(F.sum("saved"), F.sum("raw")).alias("percent")
    )


def expand_symbols(spark, sf_dir):
    coded = F.concat(F.lit("§tt, "), "content", F.lit(" §wt? §tix §ti"))
    return views.turns(spark, sf_dir).select("id", compression.expanded(coded, SYMBOLS).alias("content"))


def strip_context(spark, sf_dir):
    wrapped = F.concat(F.lit("<memory_context>\nold "), "id", F.lit("\n</memory_context>\n\n"), "content", F.lit(" [MEMORY CONTEXT]a\nb[END MEMORY CONTEXT] tail"))
    rows = views.turns(spark, sf_dir).select("id", F.when(F.col("turn") % 2 == 0, wrapped).otherwise(F.col("content")).alias("content"))
    return rows.select("id", text.without_context(F.col("content")).alias("content"))


def purge_marked(spark, sf_dir):
    rows = views.turns(spark, sf_dir).withColumn("content", F.when(F.col("turn") % 5 == 0, F.concat(F.lit("<retrieved_context>"), "content")).otherwise(F.col("content")))
    return tables.purge(rows, "<retrieved_context>").groupBy("platform").agg(F.count("*").alias("n"))


def _graph(spark, sf_dir):
    """Entities and relations, kept for the queries that read them."""
    f, source = views.graph_facts(spark, sf_dir), [views.table(spark, sf_dir, t) for t in ("supplier", "part")]
    return kept(spark, "entities", lambda: graph.entities(f), *source), kept(spark, "relations", lambda: graph.relations(f), *source)


def kg_entities(spark, sf_dir):
    return graph.entities(views.graph_facts(spark, sf_dir))


def kg_relations(spark, sf_dir):
    return graph.relations(views.graph_facts(spark, sf_dir))


def kg_own_patterns(spark, sf_dir):
    """Entities with a host's own project names and domain among the patterns."""
    f = views.graph_facts(spark, sf_dir).withColumn("content", F.concat("content", F.lit(" for mellow at api-"), (F.col("id") % 3).cast("string"), F.lit(".example.org")))
    return graph.entities(f, graph.with_own(["mellow"], "example.org")).where("name = 'mellow' OR name LIKE '%example.org'").select("name", "type", "mentions")


def kg_named(spark, sf_dir):
    """Which entities each fact of the graph names, by one pass over the facts."""
    ents, _ = _graph(spark, sf_dir)
    return patterns.found(views.graph_facts(spark, sf_dir).select("id", F.lower("content").alias("content")), ents)


def compress_phrases(spark, sf_dir):
    """Turns with a dictionary's phrases replaced, all in one pass."""
    phrases = spark.createDataFrame(SYMBOLS, "phrase string, symbol string")
    return patterns.replaced(views.turns(spark, sf_dir), phrases)


def kg_walk(spark, sf_dir):
    ents, rels = _graph(spark, sf_dir)
    return graph.walk(graph.seeds(ents, "what uses redis here"), rels)


def kg_reach(spark, sf_dir):
    """Walks of three hops from every entity, over a stored table of neighbours."""
    ents, rels = _graph(spark, sf_dir)
    near = adjacency.stored_adjacency(rels)
    return adjacency.walked(near, ents.select(F.col("name").alias("seed"), "name"), 3, by=["seed"])


def kg_block(spark, sf_dir):
    ents, rels = _graph(spark, sf_dir)
    return graph.block(materialised(graph.walk(graph.seeds(ents, "what uses redis here"), rels)), ents, rels)


def kg_stats(spark, sf_dir):
    return graph.stats(*_graph(spark, sf_dir))


def kg_top(spark, sf_dir):
    return graph.top_entities(kg_entities(spark, sf_dir)).select("name", "type", "mentions")


def sse_reassemble(spark, sf_dir):
    return sse.reassemble(views.stream_packets(spark, sf_dir))


def sse_usage(spark, sf_dir):
    """Usage frames made of usage events, one stream for each user."""
    u = views.usage(spark, sf_dir)
    claude = F.concat(F.lit('data: {"type":"message_start","message":{"usage":{"input_tokens":'), "input_tokens", F.lit('}}}\ndata: {"type":"message_delta","usage":{"output_tokens":'), "output_tokens", F.lit("}}\n"))
    other = F.concat(F.lit('data: {"usage":{"prompt_tokens":'), "input_tokens", F.lit(',"completion_tokens":'), "output_tokens", F.lit("}}\n"))
    packet = F.when(F.col("seq") % 2 == 0, claude).otherwise(other)
    return sse.usage_of_frames(u.select(F.col("user_id").cast("string").alias("stream_id"), F.lit("claude").alias("platform"), F.lit(None).cast("string").alias("conversation_id"), "seq", packet.alias("packet")))


def url_match(spark, sf_dir):
    p = views.table(spark, sf_dir, "pages")
    made = F.element_at(
        F.array(
            F.concat(F.lit("https://claude.ai/api/organizations/o1/chat_conversations/c"), F.col("page_id").cast("string"), F.lit("/completion")), F.lit("https://chatgpt.com/backend-api/conversation"),
            F.lit("https://gemini.google.com/_/BardChatUi/data/StreamGenerate"), F.lit("https://www.perplexity.ai/api/query"), F.lit("https://claude.ai/login"), F.col("url"),
        ),
        (F.col("page_id") % 6 + 1).cast("int"),
    )
    return sse.match_endpoints(p.select("page_id", made.alias("url"))).select("page_id", "platform", "conversation_id")


def artifact_extract(spark, sf_dir):
    opened = F.concat(F.lit('<antArtifact identifier="a'), "id", F.lit('" title="T '), "id", F.lit('">'), "content", F.lit("</antArtifact>"))
    block = F.when(F.col("turn") % 2 == 0, opened).otherwise(F.col("content"))
    kind = F.when(F.col("turn") % 3 == 0, "tool_result").otherwise("text")
    messages = views.turns(spark, sf_dir).select(F.col("id").alias("message_id"), "role", F.to_json(F.array(F.struct(kind.alias("type"), block.alias("text")))).alias("content"))
    return history.artifacts(messages)


def history_turns(spark, sf_dir):
    t = views.turns(spark, sf_dir)
    content = F.when(F.col("turn") % 2 == 0, F.to_json(F.array(F.struct(F.lit("text").alias("type"), F.col("content").alias("text")), F.struct(F.lit("image").alias("type"), F.lit("x").alias("text")))))
    content = content.when(F.col("turn") % 5 == 3, F.lit("  ")).otherwise(F.col("content"))
    sender = F.when(F.col("role") == "user", "human").otherwise(F.col("role"))
    stamp = F.date_format(F.timestamp_millis("ts_ms"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return history.history_turns(t.select("conv_id", F.col("id").alias("uuid"), sender.alias("sender"), content.alias("content"), F.lit(None).cast("string").alias("text"), stamp.alias("created_at")))


def user_message_extract(spark, sf_dir):
    body = (
        F.when(F.col("platform") == "claude", F.to_json(F.struct(F.array(F.struct(F.col("role").alias("role"), F.col("content").alias("content"))).alias("messages"))))
        .when(F.col("platform") == "chatgpt", F.to_json(F.struct(F.array(F.struct(F.struct(F.array("content", F.lit("!")).alias("parts")).alias("content"))).alias("messages"))))
        .otherwise(F.to_json(F.struct(F.col("content").alias("query"))))
    )
    return values.parsed(views.turns(spark, sf_dir), body).select("id", sse.user_message(F.col("json"), F.col("platform")).alias("message"))


def token_islands(spark, sf_dir):
    return telemetry.islands(views.usage(spark, sf_dir))


def token_cost(spark, sf_dir):
    per = views.usage(spark, sf_dir).groupBy("user_id").agg(F.sum("input_tokens").alias("i"), F.sum("output_tokens").alias("o"))
    cost = text.cost_dollars(F.col("i"), F.col("o"))
    return per.select("user_id", text.short_number(F.col("i")).alias("input"), text.short_number(F.col("o")).alias("output"), text.cost_label(cost).alias("cost"), text.percent(F.col("o"), F.col("i")).alias("percent"))


def memory_health(spark, sf_dir):
    per = views.usage(spark, sf_dir).groupBy("user_id").agg(((F.max("ts_ms") - F.min("ts_ms")) / 100_000).alias("s"), F.sum("input_tokens").alias("chars"), F.count("*").alias("n"), F.countDistinct("conversation_id").alias("d"))
    score = telemetry.memory_health(F.col("s") % 1000, F.col("chars") % 3000, F.col("n") % 10, F.col("d"))
    return per.select("user_id", score.alias("score"), telemetry.health_label(score).alias("label"))


def injection_stats(spark, sf_dir):
    rows = views.usage(spark, sf_dir).select((F.col("ts_ms") * 100_000 + F.col("seq")).alias("ts_ms"), F.col("input_tokens").alias("size"), F.col("conversation_id").alias("layers"))
    return telemetry.latest_injection(rows)


def vector_stats(spark, sf_dir):
    return telemetry.vector_stats(_vectors(spark, sf_dir).withColumn("created_at", views.EPOCH_MS + F.col("id") * 1000))


def delta_query(spark, sf_dir):
    return conversation.new_words_query(views.turns(spark, sf_dir))


def query_extract(spark, sf_dir):
    wrapped = F.concat(F.lit("--- a. b. ---"), "content")
    return views.turns(spark, sf_dir).select("id", text.last_sentences(wrapped).alias("query"))


def extraction_text(spark, sf_dir):
    return conversation.extraction_text(views.turns(spark, sf_dir))


def to_extract(spark, sf_dir):
    extracted = _rollup(spark, sf_dir).where("conv_id % 3 = 0").select("conv_id", (F.col("updated_at") - F.when(F.col("conv_id") % 2 == 0, 1).otherwise(0)).alias("extracted_at"))
    return conversation.to_extract(_rollup(spark, sf_dir), extracted).select("conv_id", "turn_count")


def unsynced_flatten(spark, sf_dir):
    return conversation.flush_rows(views.turns(spark, sf_dir), _rollup(spark, sf_dir), _synced(spark, sf_dir))


def migration_batches(spark, sf_dir):
    return conversation.migration_batches(views.turns(spark, sf_dir))


def backfill_todo(spark, sf_dir):
    r = _rollup(spark, sf_dir)
    listing = r.select("conv_id", F.col("turn_count").alias("message_count"))
    done = r.where("conv_id % 4 > 0").select("conv_id", (F.col("turn_count") - F.col("conv_id") % 2).alias("turns"))
    return history.still_to_fetch(listing, done)


def index_backfill(spark, sf_dir):
    """Turns that an index of the even conversations lacks."""
    t = views.turns(spark, sf_dir)
    index = SearchIndex.create(spark, shared_path(spark, "index")).add(t.where("conv_id % 2 = 0"), new=True)
    return index.missing(t).select("id", "conv_id")


def upsert_latest(spark, sf_dir):
    """The last copy of each turn, after the copies were put into a keyed table of the turns."""
    t = views.turns_with_copies(spark, sf_dir).withColumn("id", F.concat_ws("-", "conv_id", "turn")).select("id", "ts_ms", "arrival")
    table = KeyedTable.create(spark, shared_path(spark, "keyed"), t.schema, "id", 8)
    first = F.col("arrival") % 10 == 0
    return table.put(t.where(first), "ts_ms", "arrival").put(t.where(~first), "ts_ms", "arrival").read()


def delete_keys(spark, sf_dir):
    """Turns by platform, after some were deleted from a keyed table."""
    t = views.turns(spark, sf_dir).select("id", "platform", "turn")
    table = KeyedTable.create(spark, shared_path(spark, "keyed"), t.schema, "id", 8).put(t)
    return table.delete(t.where("turn = 1")).read().groupBy("platform").agg(F.count("*").alias("n"))


def rollup_arrivals(spark, sf_dir):
    """Conversations rolled up as turns arrive in three batches, the latest turns first and some of them twice."""
    t, live = views.turns(spark, sf_dir), Conversations(spark, shared_path(spark, "conversations"), 8)
    for n, part in enumerate(("turn > 2", "turn IN (1, 3)", "turn < 3")):
        live.arrive(t.where(part), n)
    return live.rollup()


def ring_buffer(spark, sf_dir):
    return tables.ring(views.turns(spark, sf_dir).withColumn("seq", F.col("conv_id") * 100 + F.col("turn")), "platform", "seq", 30).select("platform", "id")


def evict_oldest(spark, sf_dir):
    return tables.evict(views.turns(spark, sf_dir), 200, 10).select("id", "ts_ms")


def context_block(spark, sf_dir):
    """The block of the five best turns, one row."""
    top = retrieval.ranked(turn_index(spark, sf_dir).bm25(TERMS, 5)).join(views.turns(spark, sf_dir), "id")
    age = text.age_label((F.lit(AS_OF_MS) - F.col("ts_ms")) / 60_000)
    line = F.concat(F.lit("["), age, F.lit("] "), "role", F.lit(": "), text.truncated(F.col("content"), 80))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))), lambda x: x["line"]), "\n")
    return top.agg(F.concat(F.lit("<retrieved_context>\n"), body, F.lit("\n</retrieved_context>")).alias("block"))


def export_import(spark, sf_dir):
    """Turns after an export and an import again."""
    rows = tables.export_rows(views.turns(spark, sf_dir))
    return tables.imported(rows, F.col("payload")).select("conv_id", "turn", "id", "platform", "role", "content", "ts_ms")


def point_lookup(spark, sf_dir):
    return tables.point(views.turns(spark, sf_dir), "id", "7-1").select("id", "role", "content")


def settings_default(spark, sf_dir):
    known = views.table(spark, sf_dir, "region").select(F.col("r_name").alias("key"), F.col("r_regionkey").cast("string").alias("value"))
    return tables.setting(known, "ASIA", "none").unionByName(tables.setting(known, "ATLANTIS", "none"))


def composite_key(spark, sf_dir):
    """Keys of turns whose conversation may be unknown."""
    t = views.turns(spark, sf_dir).withColumn("conv", F.when(F.col("turn") != 1, F.col("conv_id").cast("string")))
    return t.select("id", conversation.key(F.col("platform"), F.col("conv"), F.col("id")).alias("key"))


def last_turns(spark, sf_dir):
    return conversation.last_turns(views.turns(spark, sf_dir), 3).select("conv_id", "turn", "role")


def extraction_totals(spark, sf_dir):
    """Facts that a pass in id order takes as new, and those that it takes as duplicates, by category."""
    known = views.facts(spark, sf_dir)
    new = facts.fuzzy_distinct(known).withColumn("new", F.lit(True))
    return known.join(new, "id", "left").groupBy("category").agg(F.count_if(F.col("new")).alias("new"), F.count_if(F.col("new").isNull()).alias("duplicates"))


def injection_guard(spark, sf_dir):
    marked = views.turns(spark, sf_dir).withColumn("content", F.when(F.col("turn") % 3 == 0, F.concat(F.lit("<memory_context>x</memory_context>"), "content")).otherwise(F.col("content")))
    return marked.where(~text.has_context(F.col("content"))).select("id")


def fact_block(spark, sf_dir):
    """The block of the facts that bear on a message, one row."""
    known = views.facts(spark, sf_dir)
    top = retrieval.ranked(retrieval.relevant_facts(known, "that the thing with thtion from ernt and this", AS_OF_MS, 0.2)).join(known, "id")
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.concat(F.lit("- "), "content", F.lit(" ("), "confidence", F.lit(")")).alias("line")))), lambda x: x["line"]), "\n")
    return top.agg(F.concat(F.lit("<memory_context>\n"), lines, F.lit("\n</memory_context>")).alias("block"))


def response_json(spark, sf_dir):
    """Bodies that are JSON, up to 50,000 characters; others are null."""
    body = F.when(F.col("page_id") % 2 == 0, F.to_json(F.struct("html"))).otherwise(F.col("html"))
    return views.table(spark, sf_dir, "pages").select("page_id", F.length(sse.response_body(body)).alias("n"))


def reembed_texts(spark, sf_dir):
    vectors = _vectors(spark, sf_dir).select("id", F.concat(F.lit("text "), "id").alias("text"), F.col("id").alias("created_at"), "vector")
    return tables.stripped_for_reembedding(vectors)


def newest_events(spark, sf_dir):
    return tables.newest(_events(spark, sf_dir), "event_id", 30).select("event_id", "event_type")


def average_latency(spark, sf_dir):
    """Rounded mean of a measure by kind of event."""
    return _events(spark, sf_dir).groupBy("event_type").agg(F.floor(F.avg("value") + 0.5).cast("long").alias("ms"), F.count("*").alias("n"))


def _events(spark, sf_dir):
    return views.table(spark, sf_dir, "events")


def window_tumbling(spark, sf_dir):
    return windows.tumbling(_events(spark, sf_dir), "1 hour")


def window_sliding(spark, sf_dir):
    return windows.sliding(_events(spark, sf_dir), "1 hour", "30 minutes")


def window_sessions(spark, sf_dir):
    return windows.sessions(_events(spark, sf_dir), "30 minutes")


def grouping_sets(spark, sf_dir):
    g = views.table(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus")
    return g.agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"), F.grouping_id().cast("long").alias("level"))


def as_of_join(spark, sf_dir):
    e = _events(spark, sf_dir)
    left = e.where("event_type = 'click'").select("user_id", F.col("event_id"), (F.unix_millis(F.col("ts").cast("timestamp")) * 100_000 + F.col("event_id")).alias("at"))
    right = e.where("event_type = 'view'").select("user_id", (F.unix_millis(F.col("ts").cast("timestamp")) * 100_000 + F.col("event_id")).alias("at"), F.col("value").alias("seen"))
    return windows.as_of(left, right, "user_id", "at", "seen").select("event_id", "seen")


def approx_distinct(spark, sf_dir):
    return views.table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.approx_count_distinct("l_orderkey", 0.02).alias("orders"))


def approx_distinct_error(spark, sf_dir):
    """Whether approximate counts are within 5 % of exact ones."""
    both = views.table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.approx_count_distinct("l_orderkey", 0.02).alias("near"), F.countDistinct("l_orderkey").alias("exact"))
    return both.select("l_returnflag", "exact", (F.abs(F.col("near") - F.col("exact")) <= F.col("exact") * 0.05).alias("within"))


def facts_by_time(spark, sf_dir):
    return retrieval.facts_by_time(views.facts(spark, sf_dir)).select("id", "ts_ms")


def symbols_by_frequency(spark, sf_dir):
    return phrases.by_frequency(symbol_dictionary(spark, sf_dir)).select("symbol", "phrase", "freq")


def spec_block(spark, sf_dir):
    """The block that tells a reader the 20 best symbols of the turns' dictionary, one row."""
    return compression.spec_of(symbol_dictionary(spark, sf_dir), F.desc("value"), "phrase")


def context_sections(spark, sf_dir):
    """What goes before each user message: the turn before it as session context, and what it says itself where it is long."""
    t = views.turns(spark, sf_dir)
    before = F.lag("content").over(Window.partitionBy("conv_id").orderBy("turn"))
    rows = t.withColumn("before", before).where("role = 'user'")
    return rows.select("id", retrieval.context_blocks(F.col("before"), F.when(F.length("content") > 200, F.col("content")), "atlas").alias("block"))


def enrichment_blocks(spark, sf_dir):
    kind = F.when(F.col("turn") % 3 == 0, F.col("role"))
    return views.turns(spark, sf_dir).select("id", retrieval.enrichment_block(F.concat(F.lit(" "), "content", F.lit("  ")), kind).alias("block"))


def merged_lists(spark, sf_dir):
    """Newest turns and best turns as one list; the payload of the second one wins."""
    t = views.turns(spark, sf_dir)
    legs = [retrieval.ranked(retrieval.recent(t, 40)), retrieval.ranked(turn_index(spark, sf_dir).bm25(TERMS, 40)).withColumn("method", F.lit("keyword"))]
    return retrieval.merged_lists(legs, ["method"])


def embedded_turns(spark, sf_dir):
    """Turns with vectors from an embedder that is put in: here of their length and their first character."""
    embed = lambda c: F.array(F.length(c).cast("double"), F.ascii(c).cast("double"), F.lit(0.0))
    rows = retrieval.embedded(views.turns(spark, sf_dir), embed)
    return rows.select("id", *[F.round(F.element_at("vector", i), 6).alias(f"v{i}") for i in (1, 2)])


def extracted_facts(spark, sf_dir):
    """Facts from an extractor that is put in: here one that makes a fact of each conversation's first words."""
    words = F.array_join(F.slice(F.split("text", " "), 2, 4), " ")
    extract = lambda rows: rows.withColumn("answer", F.concat(F.lit("```json\n"), F.to_json(F.array(F.struct(words.alias("content"), F.lit("HIGH").alias("confidence")))), F.lit("\n```")))
    return facts.extracted(conversation.extraction_text(views.turns(spark, sf_dir)), extract).select("conv_id", "content", "category", "confidence")


FLUSHED_MS = views.EPOCH_MS + 10**12


def sync_flush(spark, sf_dir):
    """What is synced once the unsynced conversations were sent."""
    sent = conversation.flush_rows(views.turns(spark, sf_dir), _rollup(spark, sf_dir), _synced(spark, sf_dir))
    return conversation.mark_synced(_synced(spark, sf_dir), sent, FLUSHED_MS)


def engine_unsynced(spark, sf_dir):
    """Conversations to send, after an engine took in the first turns, sent them and took in the rest."""
    t, e = views.turns(spark, sf_dir), Engine(spark, shared_path(spark, "engine"), 8)
    e.capture(t.where("turn < 4"), 0)
    e.flush(lambda rows: rows.write.format("noop").mode("overwrite").save(), views.EPOCH_MS + 36_000_000)
    e.capture(t, 1)
    return e.unsynced().select("conv_id", "turn_count", "updated_at")


def sync_log(spark, sf_dir):
    """The log after a flush and one that failed."""
    sent = conversation.flush_rows(views.turns(spark, sf_dir), _rollup(spark, sf_dir), _synced(spark, sf_dir))
    return conversation.sync_log(conversation.sync_entry(sent, FLUSHED_MS).unionByName(conversation.sync_entry(sent, FLUSHED_MS + 1, "timed out")))


def migration_tallies(spark, sf_dir):
    t = views.turns(spark, sf_dir).withColumn("content", F.when(F.col("turn") != 2, F.col("content")).otherwise(" "))
    return conversation.migration_tallies(t, t.where("conv_id % 3 = 0"))


def import_all(spark, sf_dir):
    """Facts and settings after half of them were exported to files and put back into a table of the rest."""
    known = views.facts(spark, sf_dir).select(F.col("id").cast("string").alias("key"), F.col("confidence").alias("value"))
    settings = views.table(spark, sf_dir, "nation").select(F.col("n_name").alias("key"), F.col("n_regionkey").cast("string").alias("value"))
    path = shared_path(spark, "export")
    half = lambda df: df.where(F.pmod(F.crc32("key"), F.lit(2)) == 0)
    tables.export_all(path, 1, "2024-01-01T00:00:00Z", facts=half(known), settings=half(settings))
    back = tables.import_all(spark, path, {n: "key string, value string" for n in ("facts", "settings", "syncLog")})
    others = {n: df.withColumn("value", F.when(F.pmod(F.crc32("key"), F.lit(2)) == 0, "old").otherwise(F.col("value"))) for n, df in (("facts", known), ("settings", settings))}
    out = [tables.merged(df, back[n], "key").select(F.lit(n).alias("part"), "key", "value") for n, df in others.items()]
    return out[0].unionByName(out[1]).unionByName(back["syncLog"].select(F.lit("syncLog").alias("part"), "key", "value"))


def overwritten_settings(spark, sf_dir):
    """Settings after one table of them was written over another."""
    path = shared_path(spark, "settings")
    nations = views.table(spark, sf_dir, "nation").select(F.col("n_name").alias("key"), F.col("n_regionkey").cast("string").alias("value"))
    tables.overwritten(tables.cleared(nations)[0], path)
    return tables.overwritten(nations.where("value <> '0'"), path)


def history_pages(spark, sf_dir):
    """Items of pages of 50 turns, one of them broken, up to the first page that is not full."""
    at = F.expr("CAST(conv_id * 6 + turn AS INT)")
    t = views.turns(spark, sf_dir).where("turn < 6").select(F.expr("CAST((conv_id * 6 + turn) DIV 50 AS INT)").alias("page"), at.alias("n"), F.to_json(F.struct("id", "role")).alias("item"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("n", "item"))), lambda x: x["item"])
    pages = t.groupBy("page").agg(listed.alias("items"))
    full = F.when(F.size("items") < 50, F.concat("items", F.array_repeat(F.lit('{"id":"-"}'), 50))).otherwise(F.col("items"))
    body = F.when(F.col("page") == 3, "{broken").when(F.col("page") == 9, F.concat(F.lit("["), F.array_join(F.slice("items", 1, 2), ","), F.lit("]"))).otherwise(F.concat(F.lit("["), F.array_join(full, ","), F.lit("]")))
    return history.page_items(pages.select("page", body.alias("body"))).select("page", "at", F.get_json_object("item", "$.id").alias("id"), "error")


QUERIES = {
    f.__name__: f
    for f in (
        bm25_topk, bm25_scan, index_changes, bm25_terms, bm25_stats, vector_topk, vector_same_model, vector_normalised, rrf_hybrid, recent_turns, layered_retrieval, fact_relevance, facts_by_confidence,
        conversation_rollup, conversation_stats, platform_breakdown, conversations_recent, conversations_cursor, conversations_changed, popup_rows, role_normalise, content_normalise, content_shapes, content_schemas,
        turn_dedup, fact_similar_pairs, fact_fuzzy_dedup, fact_members, fact_search, fact_valid, fact_answers, ngram_counts, phrases_mined, symbol_candidates, symbol_dictionary, compress_static, compress_dictionary,
        compression_savings, expand_symbols, strip_context, purge_marked, kg_entities, kg_relations, kg_named, compress_phrases, kg_walk, kg_reach, kg_block, kg_stats, kg_top, sse_reassemble, sse_usage, url_match, artifact_extract,
        history_turns, user_message_extract, token_islands, token_cost, memory_health, injection_stats, vector_stats, delta_query, query_extract, extraction_text, to_extract, unsynced_flatten,
        migration_batches, backfill_todo, index_backfill, upsert_latest, rollup_arrivals, delete_keys, ring_buffer, evict_oldest, context_block, export_import, window_tumbling, window_sliding, window_sessions,
        grouping_sets, as_of_join, approx_distinct, point_lookup, settings_default, composite_key, last_turns, extraction_totals, injection_guard, fact_block, response_json, reembed_texts,
        newest_events, average_latency, kg_own_patterns, approx_distinct_error, facts_by_time, symbols_by_frequency, spec_block, context_sections, enrichment_blocks, merged_lists, embedded_turns, extracted_facts, sync_flush, engine_unsynced,
        sync_log, migration_tallies, import_all, overwritten_settings, history_pages,
    )
}
