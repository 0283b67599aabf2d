"""DuckDB SQL of the same queries, written apart from the DataFrame code; fixed values alone are shared."""

from __future__ import annotations

from palimpsest.functions.compression import SPEC_HEAD, SPEC_TAIL, SPEC_USE, STATIC_RULES
from palimpsest.functions.text import CONTEXT_MARKERS, PHRASE_STOP_WORDS, STOP_WORDS, context_pattern
from palimpsest.operators.graph import ENTITY_PATTERNS, RELATION_PATTERNS
from palimpsest.sources.views import CATEGORIES, CONFIDENCES, EPOCH_MS, PLATFORMS

AS_OF = EPOCH_MS + 600_000 * 1000


def _list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

TURNS = f"""turns AS (
  SELECT conv_id || '-' || turn AS id, conv_id, turn, {_list(PLATFORMS)}[conv_id % 4 + 1] AS platform, role, text AS content,
         {EPOCH_MS} + conv_id * 3600000 + turn * 60000 AS ts_ms
  FROM conversations)"""

FACTS = f"""facts AS (
  SELECT doc_id AS id, text AS content, {_list(CATEGORIES)}[doc_id % 9 + 1] AS category, {_list(CONFIDENCES)}[doc_id % 3 + 1] AS confidence,
         {EPOCH_MS} + doc_id * 600000 AS ts_ms
  FROM documents)"""

COPIES = f"""{TURNS}, copies AS (
  SELECT *, turn * 10 AS arrival FROM turns
  UNION ALL SELECT * REPLACE (id || '-a' AS id, ts_ms + 1000 AS ts_ms), turn * 10 + 1 FROM turns WHERE turn % 3 = 0
  UNION ALL SELECT * REPLACE (id || '-b' AS id, ts_ms + 6000 AS ts_ms), turn * 10 + 2 FROM turns WHERE turn % 3 = 0)"""

USAGE = """usage AS (
  SELECT event_id AS seq, user_id, (event_id // 4) % 3 AS conversation_id, CAST(floor(abs(value) * 10) AS BIGINT) AS input_tokens,
         CAST(floor(abs(value) * 3) AS BIGINT) AS output_tokens, (epoch_us(ts) // 1000) AS ts_ms
  FROM events)"""

INDEX = f"""{TURNS}, tokens AS (
  SELECT id, list_filter(regexp_split_to_array(regexp_replace(lower(content), '[^a-z0-9\\s_-]', ' ', 'g'), '\\s+'),
                         lambda w: length(w) > 1 AND NOT list_contains({_list(STOP_WORDS)}, w)) AS w
  FROM turns WHERE length(trim(content)) >= 10
), docs AS (SELECT id, w, len(w) AS dl FROM tokens WHERE len(w) > 0)"""


CHANGED = f"""{TURNS.replace('turns AS', 'base AS')}, turns AS (
  SELECT * REPLACE (CASE WHEN turn < 2 THEN content || ' thing thing' ELSE content END AS content) FROM base WHERE (conv_id % 2 = 0 OR turn < 2) AND conv_id % 5 <> 0)"""


def bm25(terms: list[str], k: int, name: str = "top") -> str:
    """CTEs over INDEX that end in ``name`` (id, score, rank)."""
    values = ", ".join(f"('{t}', {terms.count(t)})" for t in sorted(set(terms)))
    return f"""q(term, times) AS (VALUES {values}
), tf AS (
  SELECT id, dl, term, times, len(list_filter(w, lambda x: x = term)) AS tf FROM docs, q
), df AS (SELECT term, count(*) AS df FROM tf WHERE tf > 0 GROUP BY term
), st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM docs
), scored AS (
  SELECT id, round(sum(times * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))), 6) AS score
  FROM tf JOIN df USING (term), st WHERE tf > 0 GROUP BY id
), {name} AS (SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM scored WHERE score > 0 ORDER BY score DESC, id LIMIT {k})"""


TERMS = ["thing", "thtion", "ernt", "thing"]

ROLLUP = f"""{TURNS}, rolled AS (
  SELECT conv_id, min_by(platform, turn) AS platform, coalesce(min_by(content, turn) FILTER (role = 'user'), '(untitled)') AS t,
         min_by(ts_ms, turn) AS started_at, max(ts_ms) AS updated_at, count(*) AS turn_count, CAST(ceil(sum(length(content)) / 4) AS BIGINT) AS token_estimate
  FROM turns GROUP BY conv_id
), rollup AS (SELECT * EXCLUDE (t), CASE WHEN length(t) > 120 THEN t[:117] || '...' ELSE t END AS title FROM rolled
), synced AS (
  SELECT * FROM (SELECT conv_id, CASE WHEN conv_id % 2 = 1 THEN started_at + 120000 WHEN conv_id % 3 <> 0 THEN updated_at END AS synced_at FROM rollup) WHERE synced_at IS NOT NULL)"""

VECTORS = """v AS (SELECT vec_id AS id, embedding AS e, label AS model FROM embeddings
), cos AS (
  SELECT q.id AS query_id, v.id, q.model AS qm, v.model AS vm, round(list_cosine_similarity(v.e::DOUBLE[], q.e::DOUBLE[]), 4) AS score
  FROM v, (SELECT * FROM v WHERE id % 100 = 0) q)"""


def _compress(text: str, symbols=()) -> str:
    out = text
    for pattern, by in STATIC_RULES:
        out = "regexp_replace({}, '{}', '{}', 'g')".format(out, pattern.replace("'", "''"), by.replace("'", "''"))
    for phrase, symbol in sorted(symbols, key=lambda s: -len(s[0])):
        out = f"regexp_replace({out}, '(?i){phrase}', '{symbol}', 'g')"
    return rf"CASE WHEN length({text}) < 30 THEN {text} ELSE regexp_replace(trim(regexp_replace({out}, '\s+', ' ', 'g')), ' +([.,;:])', '\1', 'g') END"


WORDY = f"""{TURNS}, wordy AS (
  SELECT id, ['In order to ', 'Basically, ', 'It''s worth noting that ', ''][turn % 4 + 1] || content || ' as well as the documentation , for example. Hope this helps' AS content FROM turns)"""

SYMBOLS = [("that the", "§tt"), ("with the", "§wt"), ("tion", "§ti")]

GRAMS = f"""{TURNS}, whole AS (SELECT conv_id, string_agg(content, ' ' ORDER BY turn) AS content FROM turns GROUP BY conv_id
), words AS (
  SELECT conv_id, list_filter(string_split(trim(regexp_replace(regexp_replace(lower(content), '[^a-z0-9\\s''-]', ' ', 'g'), '\\s+', ' ', 'g')), ' '), lambda x: length(x) > 1) AS w
  FROM whole WHERE length(content) >= 10
), grams AS (
  SELECT conv_id, array_to_string(w[i:i + n - 1], ' ') AS phrase, w[i] AS f, w[i + n - 1] AS l
  FROM (SELECT conv_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM words, range(2, 7) r(n) WHERE len(w) >= n)
), counts AS (
  SELECT phrase, count(*) AS freq, count(DISTINCT conv_id) AS n_convs FROM grams
  WHERE length(phrase) >= 6 AND NOT list_contains({_list(PHRASE_STOP_WORDS)}, f) AND NOT list_contains({_list(PHRASE_STOP_WORDS)}, l)
  GROUP BY phrase HAVING count(*) >= 2
), cand AS (
  SELECT *, (tokens - 1) * freq - 3 AS value FROM (SELECT *, greatest(1, CAST(ceil(length(phrase) / 4) AS BIGINT)) AS tokens FROM counts) WHERE tokens > 1 AND (tokens - 1) * freq > 3)"""

_TOOLS, _PLACES = ["redis", "docker", "nginx", "postgres", "ollama"], ["vps1", "homelab", "ubuntu", "debian"]

KG = f"""kf AS (
  SELECT s_suppkey AS id, 'BillingGateway uses ' || {_list(_TOOLS)}[s_suppkey % 5 + 1] || ' and runs on ' || {_list(_PLACES)}[s_suppkey % 4 + 1] || ' at port ' || (8000 + s_suppkey % 7) AS content FROM supplier
  UNION ALL
  SELECT p_partkey + 1000000, 'svc-part-' || ['alpha', 'beta', 'gamma'][p_partkey % 3 + 1] || ' depends on ' || {_list(_TOOLS)}[p_partkey % 5 + 1] || ' v1.' || (p_size % 3) || '.0 and is part of the ' || {_list(_PLACES)}[p_partkey % 4 + 1] || ' cluster' FROM part
), found AS (
  {" UNION ALL ".join(f"SELECT id, content, {n} AS p, '{prefix}' || lower(x) AS key, '{kind}' AS type, x AS shown, i FROM (SELECT id, content, unnest(regexp_extract_all(content, '{pattern}', 1)) AS x, unnest(range(len(regexp_extract_all(content, '{pattern}', 1)))) AS i FROM kf) WHERE length(x) >= {least}" for n, (pattern, kind, prefix, least) in enumerate(ENTITY_PATTERNS))}
), firsts AS (
  SELECT id, content, key, type, shown, p, i FROM found QUALIFY row_number() OVER (PARTITION BY id, key ORDER BY p, i) = 1
), ents AS (
  SELECT id, content, lower(shown) AS name, type, shown, row_number() OVER (PARTITION BY id ORDER BY p, i) AS pos FROM firsts
), near AS (
  SELECT id, pos, name AS src, lead(name) OVER (PARTITION BY id ORDER BY pos) AS dst, content[:100] AS evidence FROM ents
), said AS (
  {" UNION ALL ".join(f"SELECT kf.id, 100 * ({n} + 1) + i AS pos, e.name AS src, lower(t) AS dst, '{rel}' AS rel, m AS evidence FROM (SELECT id, unnest(regexp_extract_all(content, '{pattern}', 1)) AS t, unnest(regexp_extract_all(content, '{pattern}', 0)) AS m, unnest(range(len(regexp_extract_all(content, '{pattern}', 0)))) AS i FROM kf) kf JOIN ents e ON e.id = kf.id AND e.pos = 1 WHERE length(t) >= 2" for n, (pattern, rel) in enumerate(RELATION_PATTERNS))}
), rel_rows AS (
  SELECT id, pos, src, dst, 'CO_OCCURS_WITH' AS rel, evidence, 0.4 AS c FROM near WHERE dst IS NOT NULL
  UNION ALL SELECT id, pos, src, dst, rel, evidence, 0.75 FROM said
), mentions AS (
  SELECT id, pos - 1 AS pos, name, type, shown FROM ents UNION ALL SELECT id, 1000 + pos, dst, 'concept', dst FROM said
), e AS (
  SELECT name, arg_min(type, (id, pos)) AS type, arg_min(shown, (id, pos)) AS shown, count(*) AS mentions, min({EPOCH_MS} + id * 1000) AS first_seen, max({EPOCH_MS} + id * 1000) AS last_seen FROM mentions GROUP BY name
), r AS (
  SELECT src AS "from", dst AS "to", rel, round(least(1.0, arg_min(c, (id, pos))::DOUBLE + (count(*) - 1) * 0.05), 6) AS confidence, arg_max(evidence, (id, pos)) AS evidence, count(*) AS n
  FROM rel_rows GROUP BY src, dst, rel
)"""

WALK = f"""{KG}, edges AS (
  SELECT DISTINCT a, b FROM (SELECT "from" AS a, "to" AS b FROM r WHERE confidence >= 0.5 UNION ALL SELECT "to", "from" FROM r WHERE confidence >= 0.5)
), h0 AS (SELECT name FROM e WHERE contains('what uses redis here', name)
), h1 AS (SELECT DISTINCT b AS name FROM edges JOIN h0 ON a = h0.name WHERE b NOT IN (SELECT name FROM h0)
), h2 AS (SELECT DISTINCT b AS name FROM edges JOIN h1 ON a = h1.name WHERE b NOT IN (SELECT name FROM h0) AND b NOT IN (SELECT name FROM h1)
), walked AS (SELECT name, 0 AS hop FROM h0 UNION ALL SELECT name, 1 FROM h1 UNION ALL SELECT name, 2 FROM h2)"""

_strip = "content"
for _b, _e in CONTEXT_MARKERS:
    _strip = f"regexp_replace({_strip}, '{context_pattern(_b, _e)}', '', 'g')"

SHORT = "CASE WHEN {0} >= 1000000 THEN printf('%.1fM', floor({0} / 100000 + 0.5) / 10) WHEN {0} >= 1000 THEN printf('%.1fK', floor({0} / 100 + 0.5) / 10) ELSE CAST({0} AS VARCHAR) END"

WORDSETS = f"""{FACTS}, sets AS (
  SELECT min(id) AS id, w FROM (SELECT id, list_sort(list_distinct(list_filter(regexp_split_to_array(lower(content), '\\s+'), lambda x: length(x) > 2))) AS w FROM facts) WHERE len(w) > 0 GROUP BY w
), posted AS (SELECT id, unnest(w) AS word FROM sets
), common AS (SELECT a.id AS a, b.id AS b, count(*) AS n FROM posted a JOIN posted b ON a.word = b.word AND a.id < b.id GROUP BY 1, 2
), pairs AS (
  SELECT a, b, round(c.n / greatest(len(x.w), len(y.w)), 6) AS similarity FROM common c JOIN sets x ON x.id = a JOIN sets y ON y.id = b WHERE round(c.n / greatest(len(x.w), len(y.w)), 6) >= 0.85)"""

ORACLE_SQL = {
    "bm25_topk": f"WITH {INDEX}, {bm25(TERMS, 16)} SELECT id, score FROM top",
    "bm25_scan": f"WITH {INDEX}, {bm25(TERMS, 16)} SELECT id, score FROM top",
    "index_changes": f"WITH {INDEX.replace(TURNS, CHANGED)}, {bm25(TERMS, 20)} SELECT id, score FROM top",
    "bm25_terms": f"WITH {INDEX} SELECT term, count(DISTINCT id) AS df, count(*) AS cf FROM (SELECT id, unnest(w) AS term FROM docs) GROUP BY term",
    "bm25_stats": f"WITH {INDEX} SELECT count(*) AS n_docs, round(avg(dl), 6) AS avg_length, CAST(sum(dl) AS BIGINT) AS n_tokens FROM docs",
    "vector_topk": f"WITH {VECTORS} SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM cos WHERE score > 0.2 QUALIFY rank <= 16",
    "vector_same_model": f"WITH {VECTORS} SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM cos WHERE score >= 0.3 AND qm = vm QUALIFY rank <= 5",
    "vector_normalised": """SELECT vec_id AS id, round(list_sum(list_transform(embedding, lambda x: (x::DOUBLE * 2 / n) ** 2)), 6) AS norm2, round(embedding[1]::DOUBLE * 2 / n, 6) AS first
FROM (SELECT *, sqrt(list_sum(list_transform(embedding, lambda x: (x::DOUBLE * 2) ** 2))) AS n FROM embeddings)""",
    "rrf_hybrid": f"""WITH {INDEX}, {bm25(TERMS, 16)}, {VECTORS}, near AS (
  SELECT query_id, (id // 6) || '-' || (id % 6) AS id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, cos.id) AS rank FROM cos WHERE score > 0.2 QUALIFY rank <= 16
), legs AS (SELECT vec_id AS query_id, id, rank, 0 AS leg FROM top, embeddings WHERE vec_id % 100 = 0 UNION ALL SELECT query_id, id, rank, 1 FROM near
), fused AS (SELECT query_id, id, round(sum(1 / (60 + rank)), 6) AS score, min((leg, rank)) AS first FROM legs GROUP BY query_id, id)
SELECT query_id, id, score, 'hybrid' AS method FROM fused QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first, id) <= 8""",
    "recent_turns": f"WITH {TURNS} SELECT id, 1.0::DOUBLE AS score, 'recent' AS method FROM turns ORDER BY ts_ms DESC, id LIMIT 6",
    "layered_retrieval": f"""WITH {INDEX}, {bm25(["thing", "thtion"], 12)}, {FACTS}, {WALK.replace("what uses redis here", "zzqx redis")},
l0 AS (SELECT 'hi' AS query, 0 AS layer, id, 1.0 AS score, 'recent' AS method FROM turns ORDER BY ts_ms DESC, id LIMIT 6),
l1 AS (SELECT 'thing thtion' AS query, 0, id, round(1 / (60 + rank), 6), 'hybrid' FROM top WHERE rank <= 6),
l2 AS (SELECT 'zzqx redis' AS query, 1, name, 2 - hop, 'graph' FROM walked),
l3 AS (SELECT 'zzqx zzqy' AS query, 2, CAST(id AS VARCHAR), CASE confidence WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END AS s, 'facts' FROM facts ORDER BY s DESC, ts_ms DESC, id LIMIT 8)
SELECT query, layer, id, score::DOUBLE AS score, method FROM (FROM l0 UNION ALL FROM l1 UNION ALL FROM l2 UNION ALL FROM l3)""",
    "fact_relevance": rf"""WITH {FACTS}, t AS (
  SELECT *, list_filter(regexp_split_to_array(regexp_replace(lower(content), '[^a-z0-9\s]', ' ', 'g'), '\s+'), lambda w: length(w) > 2) AS w FROM facts
), s AS (
  SELECT id, content, confidence, round((CASE WHEN len(w) > 0 THEN len(list_filter(w, lambda x: list_contains(['and', 'ernt', 'from', 'that', 'the', 'thing', 'this', 'thtion', 'with'], x))) / len(w) * 0.6 ELSE 0 END
    + CASE WHEN category IN ('preference', 'personal', 'work') THEN 0.15 ELSE 0 END) * CASE confidence WHEN 'high' THEN 1.0 WHEN 'medium' THEN 0.7 ELSE 0.4 END
    + CASE WHEN ({AS_OF} - ts_ms) / 3600000 < 24 THEN 0.1 ELSE 0 END + CASE WHEN ({AS_OF} - ts_ms) / 3600000 < 1 THEN 0.05 ELSE 0 END, 6) AS score FROM t
), top AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS place FROM s WHERE score >= 0.2 ORDER BY score DESC, id LIMIT 8
), sized AS (SELECT *, count(*) OVER () AS n, sum(length(content) + 5 + length(confidence)) OVER () AS size FROM top)
SELECT id, score::DOUBLE AS score FROM sized WHERE ceil((size + n - 1 + 34) / 4) <= 500 OR place <= greatest(3, n - 2)""",
    "facts_by_confidence": f"WITH {FACTS} SELECT id, confidence, ts_ms FROM facts ORDER BY CASE confidence WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END DESC, ts_ms DESC, id LIMIT 8",
    "conversation_rollup": f"WITH {ROLLUP} SELECT * FROM rollup",
    "rollup_arrivals": f"WITH {ROLLUP} SELECT * FROM rollup",
    "conversation_stats": f"""WITH {ROLLUP} SELECT count(*) AS n_conversations, CAST(sum(turn_count) AS BIGINT) AS n_turns, CAST(sum(token_estimate) AS BIGINT) AS n_tokens,
  count(*) FILTER (synced_at IS NULL OR updated_at > synced_at) AS n_unsynced, min(started_at) AS oldest, max(updated_at) AS newest FROM rollup LEFT JOIN synced USING (conv_id)""",
    "platform_breakdown": f"WITH {TURNS} SELECT platform, count(DISTINCT conv_id) AS n_conversations, count(*) AS n_turns, CAST(sum(length(content)) AS BIGINT) AS n_chars FROM turns GROUP BY platform",
    "conversations_recent": f"WITH {ROLLUP} SELECT conv_id, updated_at FROM rollup WHERE platform = 'claude' AND updated_at >= {EPOCH_MS + 3_600_000} ORDER BY updated_at DESC, conv_id LIMIT 20",
    "conversations_cursor": f"WITH {ROLLUP} SELECT conv_id, updated_at FROM rollup WHERE updated_at >= {EPOCH_MS} ORDER BY updated_at, conv_id LIMIT 20",
    "conversations_changed": f"WITH {ROLLUP} SELECT conv_id, updated_at FROM rollup WHERE updated_at > {EPOCH_MS + 36_000_000}",
    "popup_rows": f"WITH {ROLLUP} SELECT conv_id, platform, title, turn_count, updated_at, coalesce(synced_at >= updated_at, false) AS synced FROM rollup LEFT JOIN synced USING (conv_id)",
    "role_normalise": f"""WITH {TURNS} SELECT CASE WHEN lower(r) IN ('human', 'user') THEN 'user' WHEN lower(r) = 'system' THEN 'system' ELSE 'assistant' END AS role, count(*) AS n
FROM (SELECT CASE WHEN turn % 3 = 0 THEN upper(role) WHEN turn % 3 = 1 THEN 'Human' WHEN turn = 2 THEN NULL ELSE 'model' END AS r FROM turns) GROUP BY 1""",
    "content_normalise": f"WITH {TURNS} SELECT id, CASE WHEN turn % 2 = 0 THEN concat_ws(chr(10), nullif(content, ''), '  ', 'end') ELSE trim(content, {_BLANKS}) END AS content FROM turns",
    "turn_dedup": f"WITH {COPIES} SELECT conv_id, id, arrival, ts_ms FROM copies WHERE id NOT LIKE '%-a'",
    "fact_similar_pairs": f"WITH {WORDSETS} SELECT a, b, similarity FROM pairs",
    "fact_search": f"WITH {FACTS} SELECT id, category FROM facts WHERE contains(lower(content), 'thtion') OR contains(lower(category), 'thtion')",
    "fact_valid": f"""WITH {FACTS} SELECT CASE WHEN id % 4 > 0 THEN category ELSE 'general' END AS category, CASE WHEN id % 5 > 0 THEN confidence ELSE 'medium' END AS confidence, count(*) AS n
FROM facts WHERE length(content) > 5 GROUP BY 1, 2""",
    "fact_answers": f"WITH {FACTS} SELECT id, content, category, confidence FROM facts",
    "phrases_mined": f"WITH {GRAMS} SELECT phrase, freq, n_convs FROM counts",
    "ngram_counts": f"WITH {GRAMS} SELECT phrase, freq, n_convs FROM counts",
    "symbol_candidates": f"WITH {GRAMS} SELECT phrase, freq, n_convs, tokens, value FROM cand",
    "compress_static": f"WITH {WORDY} SELECT id, {_compress('content')} AS short FROM wordy",
    "compress_dictionary": f"WITH {WORDY} SELECT id, {_compress('content', SYMBOLS)} AS short FROM wordy",
    "compression_savings": f"""WITH {WORDY}, s AS (SELECT length(content) AS raw, length({_compress("content")}) AS short FROM wordy),
t AS (SELECT CAST(ceil(raw / 4) AS BIGINT) AS raw, greatest(0, CAST(ceil((raw - short) / 4) AS BIGINT)) AS saved FROM s)
SELECT CAST(sum(raw) AS BIGINT) AS raw_tokens, CAST(sum(saved) AS BIGINT) AS gross_saved, CAST(sum(saved) - {{spec}} * count(*) AS BIGINT) AS net_saved, CAST(floor(sum(saved) * 100 / sum(raw) + 0.5) AS BIGINT) AS percent FROM t""",
    "expand_symbols": f"WITH {TURNS} SELECT id, 'that the, ' || content || ' with the? §tix tion' AS content FROM turns",
    "strip_context": f"""WITH {TURNS}, wrapped AS (
  SELECT id, CASE WHEN turn % 2 = 0 THEN '<memory_context>' || chr(10) || 'old ' || id || chr(10) || '</memory_context>' || chr(10) || chr(10) || content || ' [MEMORY CONTEXT]a' || chr(10) || 'b[END MEMORY CONTEXT] tail' ELSE content END AS content FROM turns)
SELECT id, trim({_strip}) AS content FROM wrapped""",
    "purge_marked": f"WITH {TURNS} SELECT platform, count(*) AS n FROM turns WHERE turn % 5 <> 0 GROUP BY platform",
    "kg_entities": f"WITH {KG} SELECT * FROM e",
    "kg_relations": f"WITH {KG} SELECT * FROM r",
    "kg_named": f"WITH {KG} SELECT kf.id, e.name FROM kf JOIN e ON contains(lower(kf.content), e.name)",
    "compress_phrases": f"WITH {TURNS} SELECT id, regexp_replace(regexp_replace(regexp_replace(content, '(?i)that the', '§tt', 'g'), '(?i)with the', '§wt', 'g'), '(?i)tion', '§ti', 'g') AS content FROM turns",
    "kg_walk": f"WITH {WALK} SELECT name, hop FROM walked",
    "kg_reach": f"""WITH {WALK}, s1 AS (SELECT DISTINCT a AS seed, b AS name FROM edges JOIN e ON e.name = a),
s2 AS (SELECT DISTINCT seed, b AS name FROM s1 JOIN edges ON a = s1.name), s3 AS (SELECT DISTINCT seed, b AS name FROM s2 JOIN edges ON a = s2.name)
SELECT seed, name, min(hop) AS hop FROM (
  SELECT name AS seed, name, 0 AS hop FROM e UNION ALL SELECT seed, name, 1 FROM s1 UNION ALL SELECT seed, name, 2 FROM s2 UNION ALL SELECT seed, name, 3 FROM s3
) GROUP BY seed, name""",
    "kg_stats": f"WITH {KG} SELECT 'entity' AS kind, type AS key, count(*) AS n FROM e GROUP BY type UNION ALL SELECT 'relation', rel, count(*) FROM r GROUP BY rel",
    "kg_top": f"WITH {KG} SELECT name, type, mentions FROM e ORDER BY mentions DESC, name LIMIT 10",
    "sse_reassemble": f"""WITH {TURNS} SELECT id AS stream_id, platform, CAST(conv_id AS VARCHAR) AS conversation_id, content, CAST(ceil(length(content) / 40) AS BIGINT) AS chunk_count FROM turns WHERE role = 'assistant'""",
    "sse_usage": f"""WITH {USAGE} SELECT CAST(user_id AS VARCHAR) AS stream_id, coalesce(arg_max(input_tokens, seq) FILTER (input_tokens <> 0), 0) AS input_tokens, coalesce(arg_max(output_tokens, seq) FILTER (output_tokens <> 0), 0) AS output_tokens
FROM usage GROUP BY user_id""",
    "url_match": """SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'claude' WHEN 1 THEN 'chatgpt' WHEN 2 THEN 'gemini' WHEN 3 THEN 'perplexity' END AS platform, CASE WHEN page_id % 6 = 0 THEN 'c' || page_id END AS conversation_id FROM pages""",
    "artifact_extract": f"""WITH {TURNS} SELECT id AS message_id, role, 0 AS at, CASE WHEN turn % 2 = 0 THEN 'a' || id END AS artifact_id, CASE WHEN turn % 2 = 0 THEN 'T ' || id ELSE 'untitled' END AS title, 'text' AS language,
  CASE WHEN turn % 2 = 0 THEN trim(content) ELSE content END AS body FROM turns WHERE turn % 2 = 0 OR turn % 3 = 0""",
    "history_turns": f"""WITH {TURNS} SELECT id, 'claude.ai' AS platform, conv_id, role, content, 'backfill' AS capture_type, ts_ms FROM turns WHERE turn % 2 = 0 OR turn % 5 <> 3""",
    "user_message_extract": f"""WITH {TURNS} SELECT id, CASE platform WHEN 'claude' THEN CASE WHEN role = 'user' THEN content END WHEN 'chatgpt' THEN content || '!' ELSE content END AS message FROM turns""",
    "token_islands": f"""WITH {USAGE}, c AS (SELECT *, CASE WHEN conversation_id = lag(conversation_id) OVER w THEN 0 ELSE 1 END AS change FROM usage WINDOW w AS (PARTITION BY user_id ORDER BY seq)
), i AS (SELECT *, CAST(sum(change) OVER (PARTITION BY user_id ORDER BY seq) AS BIGINT) AS island FROM c)
SELECT user_id, seq, island, CAST(sum(input_tokens) OVER x AS BIGINT) AS island_input, CAST(sum(output_tokens) OVER x AS BIGINT) AS island_output, CAST(sum(input_tokens) OVER (PARTITION BY user_id ORDER BY seq) AS BIGINT) AS session_input
FROM i WINDOW x AS (PARTITION BY user_id, island ORDER BY seq)""",
    "token_cost": f"""WITH {USAGE}, p AS (SELECT user_id, CAST(sum(input_tokens) AS BIGINT) AS i, CAST(sum(output_tokens) AS BIGINT) AS o FROM usage GROUP BY user_id)
SELECT user_id, {SHORT.format("i")} AS input, {SHORT.format("o")} AS output, CASE WHEN (3 * i + 15 * o) / 1000000 < 0.001 THEN '<$0.01' ELSE '$' || printf('%.3f', floor((3 * i + 15 * o) / 1000 + 0.5) / 1000) END AS cost,
  CASE WHEN i > 0 THEN CAST(floor(o * 100 / i + 0.5) AS BIGINT) END AS percent FROM p""",
    "memory_health": f"""WITH {USAGE}, p AS (
  SELECT user_id, ((max(ts_ms) - min(ts_ms)) / 100000) % 1000 AS s, sum(input_tokens) % 3000 AS chars, count(*) % 10 AS n, count(DISTINCT conversation_id) AS d FROM usage GROUP BY user_id
), h AS (
  SELECT user_id, CAST(floor((CASE WHEN s < 30 THEN 100 WHEN s < 120 THEN 80 WHEN s < 300 THEN 55 WHEN s < 900 THEN 30 ELSE 10 END)::DOUBLE * 0.35 + least(100, floor(chars / 2000 * 100 + 0.5))::DOUBLE * 0.25
    + least(100, 12 * n)::DOUBLE * 0.25 + least(100, 20 * d)::DOUBLE * 0.15 + 0.5) AS BIGINT) AS score FROM p)
SELECT user_id, score, CASE WHEN score >= 80 THEN 'excellent' WHEN score >= 55 THEN 'good' WHEN score >= 30 THEN 'fair' ELSE 'poor' END AS label FROM h""",
    "injection_stats": f"""WITH {USAGE} SELECT count(*) AS n, max(ts_ms * 100000 + seq) AS last_ms, arg_max(input_tokens, ts_ms * 100000 + seq) AS last_size, arg_max(conversation_id, ts_ms * 100000 + seq) AS last_layers FROM usage""",
    "vector_stats": f"SELECT label AS model, count(*) AS n, CAST(floor(sum(len(embedding)) * 4 / 1024 + 0.5) AS BIGINT) AS kilobytes, min({EPOCH_MS} + vec_id * 1000) AS oldest, max({EPOCH_MS} + vec_id * 1000) AS newest FROM embeddings GROUP BY label",
    "delta_query": rf"""WITH {TURNS}, u AS (SELECT id, trim(content) AS c, lag(trim(content)) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM turns WHERE role = 'user' AND length(trim(content)) >= 15
), f AS (SELECT id, c, CASE WHEN b IS NULL THEN [] ELSE list_filter(regexp_split_to_array(lower(c), '\s+'), lambda w: length(w) > 3 AND NOT list_contains(regexp_split_to_array(lower(b), '\s+'), w)) END AS n FROM u)
SELECT id, CASE WHEN len(n) >= 5 THEN array_to_string(n[greatest(len(n) - 49, 1):], ' ') ELSE c[greatest(length(c) - 499, 1):] END AS query FROM f""",
    "query_extract": rf"""WITH {TURNS}, s AS (SELECT id, list_filter(regexp_split_to_array(regexp_replace(trim(content), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: true) AS p FROM turns)
SELECT id, array_to_string(p[greatest(len(p) - 1, 1):], ' ')[:200] AS query FROM s""",
    "extraction_text": f"""WITH {TURNS}, l AS (SELECT conv_id, turn, CASE role WHEN 'user' THEN 'User: ' ELSE 'Assistant: ' END || content[:2000] AS line, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM turns
), t AS (SELECT conv_id, string_agg(line, chr(10) || chr(10) ORDER BY turn)[:8000] AS text FROM l WHERE back <= 20 GROUP BY conv_id) SELECT * FROM t WHERE length(text) >= 100""",
    "to_extract": f"WITH {ROLLUP} SELECT conv_id, turn_count FROM rollup WHERE turn_count >= 2 AND (conv_id % 3 <> 0 OR conv_id % 2 = 0) ORDER BY conv_id LIMIT 10",
    "unsynced_flatten": f"""WITH {ROLLUP} SELECT conv_id, id, platform, role, content, ts_ms FROM turns WHERE conv_id IN (SELECT conv_id FROM rollup LEFT JOIN synced USING (conv_id) WHERE synced_at IS NULL OR updated_at > synced_at)""",
    "migration_batches": f"WITH {TURNS} SELECT CAST(ceil(row_number() OVER (ORDER BY conv_id) / 25) AS BIGINT) AS batch, conv_id, count(*) AS n_turns FROM turns GROUP BY conv_id",
    "backfill_todo": f"WITH {ROLLUP} SELECT conv_id, turn_count AS message_count FROM rollup WHERE conv_id % 4 = 0 OR conv_id % 2 = 1",
    "index_backfill": f"WITH {INDEX} SELECT d.id, conv_id FROM docs d JOIN turns USING (id) WHERE conv_id % 2 = 1",
    "upsert_latest": f"WITH {COPIES} SELECT conv_id || '-' || turn AS id, max(ts_ms) AS ts_ms, arg_max(arrival, (ts_ms, arrival)) AS arrival FROM copies GROUP BY conv_id, turn",
    "delete_keys": f"WITH {TURNS} SELECT platform, count(*) AS n FROM turns WHERE turn <> 1 GROUP BY platform",
    "ring_buffer": f"WITH {TURNS} SELECT platform, id FROM turns QUALIFY row_number() OVER (PARTITION BY platform ORDER BY conv_id * 100 + turn DESC) <= 30",
    "evict_oldest": f"WITH {TURNS} SELECT id, ts_ms FROM turns ORDER BY ts_ms DESC, id DESC LIMIT 200",
    "context_block": f"""WITH {INDEX}, {bm25(TERMS, 5)}, l AS (
  SELECT rank, ({AS_OF} - ts_ms) / 60000 AS m, role, content FROM top JOIN turns USING (id)
), x AS (SELECT rank, '[' || CASE WHEN m < 60 THEN CAST(floor(m + 0.5) AS BIGINT) || 'm ago' WHEN m < 1440 THEN CAST(floor(m / 60 + 0.5) AS BIGINT) || 'h ago' ELSE CAST(floor(m / 1440 + 0.5) AS BIGINT) || 'd ago' END || '] ' || role || ': '
    || CASE WHEN length(content) > 80 THEN content[:77] || '...' ELSE content END AS line FROM l)
SELECT '<retrieved_context>' || chr(10) || string_agg(line, chr(10) ORDER BY rank) || chr(10) || '</retrieved_context>' AS block FROM x""",
    "export_import": f"WITH {TURNS} SELECT conv_id, turn, id, platform, role, content, ts_ms FROM turns",
    "point_lookup": f"WITH {TURNS} SELECT id, role, content FROM turns WHERE id = '7-1'",
    "settings_default": "SELECT CAST(r_regionkey AS VARCHAR) AS value FROM region WHERE r_name = 'ASIA' UNION ALL SELECT 'none'",
    "composite_key": f"WITH {TURNS} SELECT id, platform || ':' || CASE WHEN turn = 1 THEN 'unknown-' || id ELSE CAST(conv_id AS VARCHAR) END AS key FROM turns",
    "last_turns": f"WITH {TURNS} SELECT conv_id, turn, role FROM turns QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 3",
    "injection_guard": f"WITH {TURNS} SELECT id FROM turns WHERE turn % 3 <> 0",
    "response_json": """SELECT page_id, CASE WHEN page_id % 2 = 0 THEN least(50000, length(CAST(to_json({html: html}) AS VARCHAR))) END AS n FROM pages""",
    "reembed_texts": "SELECT vec_id AS id, 'text ' || vec_id AS text, vec_id AS created_at FROM embeddings",
    "newest_events": "SELECT event_id, event_type FROM events ORDER BY event_id DESC LIMIT 30",
    "average_latency": "SELECT event_type, CAST(floor(avg(value) + 0.5) AS BIGINT) AS ms, count(*) AS n FROM events GROUP BY event_type",
    "window_tumbling": "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "window_sliding": """SELECT start, count(*) AS n FROM (SELECT time_bucket(INTERVAL 30 MINUTE, ts) - k * INTERVAL 30 MINUTE AS start FROM events, range(2) r(k)) GROUP BY 1""",
    "window_sessions": """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)
), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, s""",
    "grouping_sets": "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty, CAST(grouping(l_returnflag, l_linestatus) AS BIGINT) AS level FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)",
    "as_of_join": """WITH e AS (SELECT *, (epoch_us(ts) // 1000) * 100000 + event_id AS at FROM events)
SELECT l.event_id, r.value AS seen FROM (SELECT * FROM e WHERE event_type = 'click') l ASOF LEFT JOIN (SELECT * FROM e WHERE event_type = 'view') r ON l.user_id = r.user_id AND l.at >= r.at""",
}

ORACLE_SQL["fact_block"] = (
    ORACLE_SQL["fact_relevance"].rpartition("SELECT id, score")[0]
    + """SELECT '<memory_context>' || chr(10) || string_agg('- ' || content || ' (' || confidence || ')', chr(10) ORDER BY place) || chr(10) || '</memory_context>' AS block
FROM sized WHERE ceil((size + n - 1 + 34) / 4) <= 500 OR place <= greatest(3, n - 2)"""
)


_SPEC_LINES = ["\n".join(SPEC_HEAD), "\n".join(SPEC_TAIL)]
_HEAD, _TAIL, _USE = ("'" + x.replace("'", "''").replace("\n", "' || chr(10) || '") + "'" for x in (*_SPEC_LINES, SPEC_USE))
ORACLE_SQL["compression_savings"] = ORACLE_SQL["compression_savings"].replace(
    "{spec}", f"(length({_HEAD} || chr(10) || 'SYMBOLS: §tt=that the §wt=with the §ti=tion' || chr(10) || {_USE} || chr(10) || {_TAIL}) // 4 + 1)"
)

# A pass in id order: of equal texts and of equal word sets the first alone is looked at, and one is kept if none
# of the smaller ones that it is similar to is.
DISTINCT = f"""{WORDSETS}, texts AS (SELECT min(id) AS id, lower(content) AS c FROM facts GROUP BY c
), worded AS (SELECT id, list_sort(list_distinct(list_filter(regexp_split_to_array(c, '\\s+'), lambda x: length(x) > 2))) AS w FROM texts
), looked AS (SELECT min(id) AS id FROM worded WHERE len(w) > 0 GROUP BY w UNION ALL SELECT id FROM worded WHERE len(w) = 0
), nodes AS MATERIALIZED (SELECT b AS id, list(a) AS smaller, row_number() OVER (ORDER BY b) AS i FROM pairs GROUP BY b
), pass(i, gone) AS (
  SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[])
  UNION ALL
  SELECT nodes.i, CASE WHEN len(list_filter(smaller, lambda x: NOT list_contains(gone, x))) > 0 THEN list_append(gone, id) ELSE gone END FROM pass JOIN nodes ON nodes.i = pass.i + 1
), kept AS (
  SELECT id FROM looked WHERE id NOT IN (SELECT unnest(gone) FROM (SELECT gone FROM pass ORDER BY i DESC LIMIT 1)))"""
ORACLE_SQL["fact_fuzzy_dedup"] = f"WITH RECURSIVE {DISTINCT} SELECT id FROM kept"
ORACLE_SQL["fact_members"] = f"""WITH RECURSIVE {DISTINCT}, lead AS (
  SELECT b, min(a) AS a FROM pairs WHERE a IN (SELECT id FROM kept) AND b NOT IN (SELECT id FROM kept) GROUP BY b)
SELECT f.id, coalesce(lead.a, s.id, t.id) AS representative
FROM facts f JOIN texts t ON lower(f.content) = t.c JOIN worded d ON d.id = t.id LEFT JOIN sets s ON s.w = d.w LEFT JOIN lead ON lead.b = s.id"""
ORACLE_SQL["extraction_totals"] = f"""WITH RECURSIVE {DISTINCT}
SELECT category, count(*) FILTER (kept.id IS NOT NULL) AS new, count(*) FILTER (kept.id IS NULL) AS duplicates FROM facts LEFT JOIN kept ON kept.id = facts.id GROUP BY category"""

# The greedy pass: best value first, what does not fit is passed over; a symbol from the phrase's letters, or the first free number.
DICTIONARY = f"""{GRAMS}, ordered AS (
  SELECT row_number() OVER (ORDER BY value DESC, phrase) AS i, phrase, freq, value, tokens + 3 AS cost, list_filter(string_split(phrase, ' '), lambda x: length(x) > 1) AS w FROM cand WHERE tokens + 3 <= 80
), named AS MATERIALIZED (
  SELECT *, array_to_string(list_transform(w, lambda x: x[1]), '') AS initials FROM ordered
), pass(i, budget, used, phrase, freq, value, cost, symbol) AS (
  SELECT CAST(0 AS BIGINT), CAST(80 AS BIGINT), CAST([] AS VARCHAR[]), CAST(NULL AS VARCHAR), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR)
  UNION ALL
  SELECT i, CASE WHEN fits THEN budget - cost ELSE budget END, CASE WHEN fits THEN list_append(used, symbol) ELSE used END, CASE WHEN fits THEN phrase END, freq, value, cost, symbol
  FROM (
    SELECT n.i, p.budget, p.used, n.phrase, n.freq, n.value, n.cost, n.cost <= p.budget AS fits,
           coalesce(list_filter(['§' || initials[:4], '§' || w[1][:3], '§' || initials[:3], '§' || w[1][:2] || coalesce(w[2][1], '')], lambda s: s <> '§' AND NOT list_contains(p.used, s))[1],
                    list_filter(list_transform(range(1, 100), lambda k: '§' || k), lambda s: NOT list_contains(p.used, s))[1]) AS symbol
    FROM pass p JOIN named n ON n.i = p.i + 1 WHERE p.budget >= 5)
), chosen AS (SELECT symbol, phrase, freq, value, cost AS spec_cost FROM pass WHERE phrase IS NOT NULL)"""
ORACLE_SQL["spec_block"] = f"""WITH RECURSIVE {DICTIONARY}, top AS (SELECT * FROM chosen ORDER BY value DESC, phrase LIMIT 20)
SELECT {_HEAD} || chr(10) || coalesce('SYMBOLS: ' || string_agg(symbol || '=' || phrase, ' ' ORDER BY value DESC, phrase) || chr(10) || {_USE} || chr(10), '') || {_TAIL} AS block FROM top"""
ORACLE_SQL["symbol_dictionary"] = f"WITH RECURSIVE {DICTIONARY} SELECT * FROM chosen"
ORACLE_SQL["symbols_by_frequency"] = f"WITH RECURSIVE {DICTIONARY} SELECT symbol, phrase, freq FROM chosen ORDER BY freq DESC, symbol LIMIT 16"

ORACLE_SQL["kg_block"] = f"""WITH {WALK}, best AS (SELECT name, hop, type, shown, mentions FROM walked JOIN e USING (name) ORDER BY hop, name LIMIT 15
), ways AS (
  SELECT "from" AS name, '→' AS way, rel, "to" AS other FROM r WHERE confidence >= 0.5 UNION ALL SELECT "to", '←', rel, "from" FROM r WHERE confidence >= 0.5 AND "from" <> "to"
), said_of AS (
  SELECT ways.* FROM ways JOIN best USING (name) WHERE hop < 2 QUALIFY row_number() OVER (PARTITION BY name ORDER BY way, rel, other) <= 4
), listed AS (SELECT name, string_agg(chr(10) || '  ' || way || ' ' || rel || ' ' || other, '' ORDER BY way, rel, other) AS lines FROM said_of GROUP BY name)
SELECT '[KNOWLEDGE GRAPH]' || chr(10) || string_agg(upper(type) || ': ' || shown || ' (seen ' || mentions || 'x)' || coalesce(lines, ''), chr(10) ORDER BY hop, name) || chr(10) || '[/KNOWLEDGE GRAPH]' AS block
FROM best LEFT JOIN listed USING (name)"""

_OWN = f"""{KG.split("), found AS (")[0]}), own AS (SELECT id FROM kf)"""
ORACLE_SQL["kg_own_patterns"] = f"""WITH {_OWN}
SELECT 'mellow' AS name, 'project' AS type, count(*) AS mentions FROM own UNION ALL SELECT 'api-' || id % 3 || '.example.org', 'location', count(*) FROM own GROUP BY 1"""
ORACLE_SQL |= {
    "approx_distinct_error": "SELECT l_returnflag, count(DISTINCT l_orderkey) AS exact, true AS within FROM lineitem GROUP BY l_returnflag",
    "facts_by_time": f"WITH {FACTS} SELECT id, ts_ms FROM facts ORDER BY ts_ms DESC, id",
    "enrichment_blocks": f"""WITH {TURNS} SELECT id, '--- ENRICHMENT [' || CASE WHEN turn % 3 = 0 THEN upper(role) ELSE 'AUTO' END || '] ---' || chr(10)
  || '(Pre-matched patterns, decisions, entities for this message.)' || chr(10) || trim(content) || chr(10) || '--- END ENRICHMENT ---' || chr(10) || chr(10) AS block FROM turns""",
    "merged_lists": f"""WITH {INDEX}, {bm25(TERMS, 40)}, newest AS (
  SELECT id, row_number() OVER (ORDER BY id) AS rank FROM (SELECT id FROM turns ORDER BY ts_ms DESC, id LIMIT 40)
), every AS (SELECT id, rank, 0 AS leg, 'recent' AS method FROM newest UNION ALL SELECT id, rank, 1, 'keyword' FROM top)
SELECT id, round(sum(1 / (60 + rank)), 6) AS score, arg_max(method, leg) AS method FROM every GROUP BY id""",
    "embedded_turns": f"""WITH {TURNS}, v AS (SELECT id, length(content)::DOUBLE AS a, unicode(content)::DOUBLE AS b FROM turns)
SELECT id, round(a / sqrt(a * a + b * b), 6) AS v1, round(b / sqrt(a * a + b * b), 6) AS v2 FROM v""",
    "extracted_facts": ORACLE_SQL["extraction_text"].rpartition("SELECT * FROM t")[0]
    + """, f AS (SELECT conv_id, trim(array_to_string(string_split(text, ' ')[2:5], ' ')) AS content, array_to_string(string_split(text, ' ')[2:5], ' ') AS raw FROM t WHERE length(text) >= 100)
SELECT conv_id, content, 'general' AS category, 'high' AS confidence FROM f WHERE length(raw) > 5""",
    "sync_flush": f"""WITH {ROLLUP} SELECT conv_id, CASE WHEN synced_at IS NULL OR updated_at > synced_at THEN {EPOCH_MS + 10**12} ELSE synced_at END AS synced_at FROM rollup LEFT JOIN synced USING (conv_id)""",
    "sync_log": f"""WITH {ROLLUP}, sent AS (SELECT conv_id FROM turns WHERE conv_id IN (SELECT conv_id FROM rollup LEFT JOIN synced USING (conv_id) WHERE synced_at IS NULL OR updated_at > synced_at))
SELECT 'sync_{EPOCH_MS + 10**12}' AS id, {EPOCH_MS + 10**12} AS timestamp, count(DISTINCT conv_id) AS conversations_flushed, count(*) AS turns_flushed, 'ok' AS status, NULL::VARCHAR AS error FROM sent
UNION ALL SELECT 'sync_{EPOCH_MS + 10**12 + 1}', {EPOCH_MS + 10**12 + 1}, 0, 0, 'error', 'timed out'""",
    "migration_tallies": f"""WITH {TURNS}, b AS (SELECT conv_id, CAST(ceil(row_number() OVER (ORDER BY conv_id) / 25) AS BIGINT) AS batch FROM turns GROUP BY conv_id)
SELECT batch, count(*) FILTER (turn <> 2 AND conv_id % 3 <> 0) AS ingested, count(*) FILTER (turn <> 2 AND conv_id % 3 = 0) AS skipped, count(*) FILTER (turn = 2) AS errors
FROM turns JOIN b USING (conv_id) GROUP BY batch""",
    "import_all": f"""WITH {FACTS} SELECT 'facts' AS part, CAST(id AS VARCHAR) AS key, confidence AS value FROM facts UNION ALL SELECT 'settings', n_name, CAST(n_regionkey AS VARCHAR) FROM nation""",
    "overwritten_settings": "SELECT n_name AS key, CAST(n_regionkey AS VARCHAR) AS value FROM nation WHERE n_regionkey <> 0",
    "history_pages": f"""WITH {TURNS}, t AS (SELECT CAST((conv_id * 6 + turn) // 50 AS INTEGER) AS page, row_number() OVER (PARTITION BY (conv_id * 6 + turn) // 50 ORDER BY conv_id * 6 + turn) - 1 AS "at", id FROM turns WHERE turn < 6
), n AS (SELECT page, count(*) AS n FROM t GROUP BY page
), every AS (
  SELECT page, "at", id FROM t WHERE page <> 3 AND (page <> 9 OR "at" < 2)
  UNION ALL SELECT page, n + k, '-' FROM n, range(50) r(k) WHERE n < 50 AND page NOT IN (3, 9))
SELECT page, CAST("at" AS INTEGER) AS "at", id, NULL::VARCHAR AS error FROM every WHERE page <= coalesce((SELECT 9 FROM n WHERE page = 9), page)
UNION ALL SELECT page, 0, NULL, 'no JSON list' FROM n WHERE page = 3""",
}

_SHAPED = f"""{TURNS}, shaped AS (SELECT *, (conv_id + turn) % 7 AS sh FROM turns)"""
ORACLE_SQL["content_shapes"] = f"""WITH {_SHAPED}
SELECT id, CASE sh WHEN 0 THEN 'STRING' WHEN 1 THEN 'ARRAY' WHEN 2 THEN 'OBJECT' WHEN 3 THEN 'BIGINT' WHEN 4 THEN 'VOID' WHEN 6 THEN 'ARRAY' END AS kind,
  CASE sh WHEN 0 THEN trim(content, {_BLANKS}) WHEN 1 THEN concat_ws(chr(10), 'one', nullif(content, '')) WHEN 2 THEN '{{"a":' || CAST(to_json(content) AS VARCHAR) || ',"b":{{"c":[1,2]}}}}'
    WHEN 3 THEN CASE WHEN turn = 0 THEN '' ELSE CAST(turn AS VARCHAR) END ELSE '' END AS content FROM shaped"""
ORACLE_SQL["content_schemas"] = f"WITH {_SHAPED} SELECT platform, 'OBJECT<a: STRING, b: OBJECT<c: ARRAY<BIGINT>>>' AS schema, count(*) AS n FROM shaped WHERE sh = 2 GROUP BY platform"
ORACLE_SQL["context_sections"] = f"""WITH {TURNS}, b AS (SELECT *, lag(content) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM turns), p AS (
  SELECT id, CASE WHEN before <> '' THEN '--- ATLAS SESSION CONTEXT ---' || chr(10) || '(Recent decisions, entities, and stable patterns from your work history.)' || chr(10) || before || chr(10) || '--- END SESSION CONTEXT ---' END AS a,
    CASE WHEN length(content) > 200 THEN '--- ATLAS RELEVANT CONTEXT ---' || chr(10) || '(Query-matched context from past sessions. Use to inform response; do not narrate.)' || chr(10) || content || chr(10) || '--- END RELEVANT CONTEXT ---' END AS z
  FROM b WHERE role = 'user')
SELECT id, nullif(concat_ws(chr(10), a, z), '') || chr(10) || chr(10) AS block FROM p"""
ORACLE_SQL["engine_unsynced"] = f"""WITH {TURNS} SELECT conv_id, count(*) AS turn_count, max(ts_ms) AS updated_at FROM turns GROUP BY conv_id
HAVING max(turn) >= 4 OR max(ts_ms) > {EPOCH_MS} + 36000000"""
