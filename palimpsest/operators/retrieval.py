"""Keyword and vector search, their fusion, and layered retrieval."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.text import relevance_tokens, retrieval_tokens
from palimpsest.operators.grid import in_cells
from palimpsest.plans.steps import materialised

K1, B, RRF = 1.5, 0.75, 60


def indexable(docs: DataFrame) -> DataFrame:
    """``docs`` (id, content) with their tokens; texts under 10 characters or without tokens are left out."""
    kept = docs.where(F.col("id").isNotNull() & (F.length(F.trim("content")) >= 10))
    # a generator of one row: what comes after it cannot run the tokenizer a second time
    return kept.withColumn("tokens", F.explode(F.array(retrieval_tokens(F.col("content"))))).where(F.size("tokens") > 0)


def index_terms(docs: DataFrame) -> DataFrame:
    """term, df, cf over ``docs`` (id, content)."""
    postings = indexable(docs).select("id", F.explode("tokens").alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf"))
    return postings.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def index_stats(docs: DataFrame) -> DataFrame:
    """One row: n_docs, avg_length, n_tokens."""
    return indexable(docs).agg(F.count("*").alias("n_docs"), F.round(F.avg(F.size("tokens")), 6).alias("avg_length"), F.sum(F.size("tokens")).cast("long").alias("n_tokens"))


def bm25(docs: DataFrame, query_terms: list[str], k: int | None = 16) -> DataFrame:
    """id, score of ``docs`` (id, content), best first; a repeated query term counts as often.

    Term frequencies of the few query terms are counted within the row, so one aggregate row is
    all that is exchanged.
    """
    terms = {t: query_terms.count(t) for t in query_terms}
    tokens = indexable(docs)
    tf = {t: F.size(F.filter("tokens", _same(t))) for t in terms}
    rows = tokens.select("id", F.size("tokens").alias("dl"), *[c.alias(f"tf{i}") for i, c in enumerate(tf.values())])
    stats = rows.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))])
    score: Column = F.lit(0.0)
    for i, times in enumerate(terms.values()):
        t, df = F.col(f"tf{i}"), F.greatest(F.col(f"df{i}"), F.lit(1))
        idf = F.ln((F.col("n") - df + 0.5) / (df + 0.5) + 1)
        score = score + F.when(t > 0, times * idf * (t * (K1 + 1)) / (t + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))).otherwise(0.0)
    scored = rows.join(F.broadcast(stats)).select("id", F.round(score, 6).alias("score")).where("score > 0")  # stats is one row
    return scored.orderBy(F.desc("score"), "id").limit(k) if k else scored


def _same(term: str):
    return lambda w: w == term


def cosine(a: Column, b: Column) -> Column:
    """0 if lengths differ or a norm is 0."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norms > 0), dot(a, b) / norms).otherwise(0.0)


def normalised(v: Column) -> Column:
    """To unit length; a zero vector stays."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when(norm > 0, F.transform(v, lambda x: x / norm)).otherwise(F.transform(v, lambda x: x.cast("double")))


def _nearest(threshold: float, k: int, strict: bool, same_model: bool):
    """A block of queries and a block of vectors to the k best of the block for each query."""

    def run(key, queries, vectors):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        def matrix(table, column):
            flat = pc.list_flatten(table.column(column).combine_chunks())
            return np.asarray(pc.fill_null(flat, float("nan")), np.float64).reshape(len(table), -1)

        out = []
        if len(queries) and len(vectors):
            every, ids = matrix(vectors, "vector"), vectors.column("id").combine_chunks()
            lengths, by_id = np.sqrt((every * every).sum(1)), pc.rank(ids, "ascending", tiebreaker="first").to_numpy()
            models = np.array(vectors.column("model").to_pylist(), object)
            for lo in range(0, len(queries), 512):
                some = queries.slice(lo, 512)
                q = matrix(some, "query")
                with np.errstate(divide="ignore", invalid="ignore"):
                    score = (q @ every.T) / (np.sqrt((q * q).sum(1))[:, None] * lengths[None, :])
                score = np.where(np.isfinite(score), score, 0.0)
                score = np.sign(score) * np.floor(np.abs(score) * 1e4 + 0.5) / 1e4
                found = score > threshold if strict else score >= threshold
                if same_model:
                    found &= np.array(some.column("query_model").to_pylist(), object)[:, None] == models[None, :]
                a, b = np.nonzero(found)
                order = np.lexsort((by_id[b], -score[a, b], a))
                a, b = a[order], b[order]
                place = np.arange(len(a)) - np.searchsorted(a, a)
                a, b = a[place < k], b[place < k]
                out.append(pa.table([some.column("query_id").combine_chunks().take(pa.array(a)), ids.take(pa.array(b)), pa.array(score[a, b])], ["query_id", "id", "score"]))
        return pa.concat_tables(out) if out else pa.table([pa.array([], t) for t in (queries.schema.field("query_id").type, vectors.schema.field("id").type, pa.float64())], ["query_id", "id", "score"])

    return run


def vector_search(
    vectors: DataFrame, queries: DataFrame, threshold: float = 0.2, k: int = 16, strict: bool = True, same_model: bool = False, query_rows: int = 8192, vector_rows: int = 8192
) -> DataFrame:
    """query_id, id, score, rank of the k best of ``vectors`` (id, vector, model) for each of ``queries`` (query_id, query, query_model).

    Blocks of queries meet blocks of vectors in tasks (``grid``), by matrix products; each pair of
    blocks hands on the k best of the block for each query.  Nothing passes the driver.  Vectors of
    another length than a query's are not found; vectors without length score 0.
    """
    kinds = dict(vectors.dtypes) | dict(queries.dtypes)
    out = f"query_id {kinds['query_id']}, id {kinds['id']}, score double"
    # equal rows share a block: of each no more than k are of use
    some = vectors.where(F.size("vector") > 0).groupBy("id", "vector", "model").agg(F.least(F.count("*"), F.lit(k)).alias("n"))
    sized = some.select("id", "vector", "model", F.explode(F.array_repeat(F.lit(0), F.col("n").cast("int"))).alias("_copy")).select("id", "vector", "model", F.size("vector").alias("dim"))
    asked = queries.where(F.size("query") > 0).select("query_id", "query", "query_model", F.size("query").alias("dim"))
    found = in_cells(asked, sized, "dim", ["query_id", "query"], ["id", "vector"], _nearest(threshold, k, strict, same_model), out, query_rows, vector_rows)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def embedded(docs: DataFrame, embed: Callable[[Column], Column]) -> DataFrame:
    """``docs`` (id, content, ...) with ``vector``: ``embed`` of their content, brought to unit length.

    ``embed`` maps a column of texts to a column of number arrays: an Arrow or Pandas UDF around a
    model, or an expression such as ``hashed_embedding``.
    """
    return docs.withColumn("vector", normalised(embed(F.col("content"))))


def hashed_embedding(text: Column, dim: int = 64) -> Column:
    """A stand-in for a model: counts of a text's tokens by a hash of their characters."""
    slots = F.transform(retrieval_tokens(text), lambda w: F.pmod(F.crc32(w), F.lit(dim)))
    return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.size(F.filter(slots, lambda s: s == i)).cast("double"))


def rrf(legs: list[DataFrame], k: int = 8, by: str | None = None) -> DataFrame:
    """id, score by reciprocal ranks of ranked lists (id, rank from 1); ties go to the earlier leg, then to its rank.

    With ``by`` there is a list for each value of that column.
    """
    own, every = [by] if by else [], None
    for n, leg in enumerate(legs):
        one = leg.select(*own, "id", "rank", F.lit(n).alias("leg"))
        every = one if every is None else every.unionByName(one)
    fused = every.groupBy(*own, "id").agg(F.round(F.sum(1 / (F.lit(RRF) + F.col("rank"))), 6).alias("score"), F.min(F.struct("leg", "rank")).alias("first"))
    order = (F.desc("score"), "first", "id")
    if by:
        best = fused.withColumn("_at", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("_at") <= k)
    else:
        best = fused.orderBy(*order).limit(k)
    return best.select(*own, "id", "score", F.lit("hybrid").alias("method"))


def ranked(top: DataFrame) -> DataFrame:
    """A short list (id, score) with ranks."""
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")))


def recent(turns: DataFrame, n: int = 6) -> DataFrame:
    return turns.orderBy(F.desc("ts_ms"), "id").limit(n).select("id", F.lit(1.0).alias("score"), F.lit("recent").alias("method"))


def facts_by_confidence(facts: DataFrame, n: int = 8) -> DataFrame:
    weight = F.when(F.col("confidence") == "high", 3).when(F.col("confidence") == "medium", 2).when(F.col("confidence") == "low", 1).otherwise(0)
    return facts.withColumn("weight", weight).orderBy(F.desc("weight"), F.desc("ts_ms"), "id").limit(n)


def first_layer(layers: list[Callable[[], DataFrame | None]]) -> DataFrame | None:
    """Rows of the first layer that has any, with its number; each layer gives a short list (id, score, method) or None.

    A layer is only made if those before it are empty, and is made once.
    """
    for n, layer in enumerate(layers):
        rows = layer()
        if rows is None:
            continue
        rows = materialised(rows.select(F.lit(n).alias("layer"), F.col("id").cast("string").alias("id"), F.col("score").cast("double").alias("score"), "method"))
        if not rows.isEmpty():
            return rows
    return None


def layered(
    query: str, turns: DataFrame, graph: Callable[[], DataFrame | None] | None, facts: DataFrame, k: int = 6, search: Callable[[list[str], int], DataFrame] | None = None
) -> DataFrame:
    """Keyword search if the query is over 5 characters, else recent turns; then the graph; then facts.

    ``graph`` makes its rows (id, score, method) when asked for, or None if it has too little to say.
    ``search`` finds (id, score) of the best turns for terms, as ``SearchIndex.bm25``; without it all turns are read.
    """
    search = search or (lambda terms, n: bm25(turns, terms, n))
    terms = query_terms(query)
    long = len(query) > 5
    first = (lambda: rrf([ranked(search(terms, 2 * k))], k) if terms else None) if long else (lambda: recent(turns, k))
    third = facts_by_confidence(facts).select("id", F.col("weight").alias("score"), F.lit("facts").alias("method"))
    found = first_layer([first, graph if graph and long else lambda: None, lambda: third])
    if found is not None:
        return found
    return turns.where(F.lit(False)).select(F.lit(0).alias("layer"), F.col("id").cast("string").alias("id"), F.lit(0.0).alias("score"), F.lit("").alias("method"))


# The sentences of the blocks that go before a message.
SESSION_NOTE = "(Recent decisions, entities, and stable patterns from your work history.)"
RELEVANT_NOTE = "(Query-matched context from past sessions. Use to inform response; do not narrate.)"
ENRICHMENT_NOTE = "(Pre-matched patterns, decisions, entities for this message.)"


def context_blocks(session: Column, relevant: Column, host: str = "") -> Column:
    """What goes before a message: a host's session context and what matches the message; null if there is neither (null or empty)."""
    name = f"{host.upper()} " if host else ""

    def part(title: str, note: str, text: Column) -> Column:
        return F.when(text != "", F.concat(F.lit(f"--- {name}{title} CONTEXT ---\n{note}\n"), text, F.lit(f"\n--- END {title} CONTEXT ---")))

    parts = F.concat_ws("\n", part("SESSION", SESSION_NOTE, session), part("RELEVANT", RELEVANT_NOTE, relevant))
    return F.when(parts != "", F.concat(parts, F.lit("\n\n")))


def enrichment_block(text: Column, kind: Column, host: str = "") -> Column:
    """A block of what was matched beforehand for a message of a kind (null: auto)."""
    name = f"{host.upper()} " if host else ""
    head = F.concat(F.lit(f"--- {name}ENRICHMENT ["), F.upper(F.coalesce(F.nullif(kind, F.lit("")), F.lit("auto"))), F.lit(f"] ---\n{ENRICHMENT_NOTE}\n"))
    return F.concat(head, F.trim(text), F.lit(f"\n--- END {name}ENRICHMENT ---\n\n"))


def facts_by_time(facts: DataFrame) -> DataFrame:
    """All facts, the newest first."""
    return facts.orderBy(F.desc("ts_ms"), "id")


def merged_lists(legs: list[DataFrame], payload: list[str]) -> DataFrame:
    """id, score and payload of ranked lists (id, rank, ...): reciprocal ranks add up, the payload of a later list wins."""
    every = None
    for n, leg in enumerate(legs):
        one = leg.select("id", "rank", F.lit(n).alias("leg"), F.struct(*payload).alias("p"))
        every = one if every is None else every.unionByName(one)
    fused = every.groupBy("id").agg(F.round(F.sum(1 / (F.lit(RRF) + F.col("rank"))), 6).alias("score"), F.max_by("p", F.struct("leg", -F.col("rank"))).alias("p"))
    return fused.select("id", "score", "p.*")


def query_terms(query: str) -> list[str]:
    """As ``retrieval_tokens``, for a query on the driver."""
    import re

    from palimpsest.functions.text import STOP_WORDS

    return [w for w in re.split(r"\s+", re.sub(r"[^a-z0-9\s_-]", " ", query.lower())) if len(w) > 1 and w not in STOP_WORDS]


def relevant_facts(facts: DataFrame, message: str, as_of_ms: int, threshold: float = 0.3, most: int = 8, budget: int = 500) -> DataFrame:
    """id, score of ``facts`` (id, content, category, confidence, ts_ms) that bear on a message.

    If the block of the chosen facts is over the budget of estimated tokens, the last two go, three at least stay.
    """
    import re

    words = sorted({w for w in re.split(r"\s+", re.sub(r"[^a-z0-9\s]", " ", message.lower())) if len(w) > 2})
    message_words = F.array(*[F.lit(w) for w in words]) if words else F.array().cast("array<string>")
    tokens = relevance_tokens(F.col("content"))
    rows = facts.withColumn("tokens", tokens)
    share = F.when(F.size("tokens") > 0, F.size(F.filter("tokens", lambda w: F.array_contains(message_words, w))) / F.size("tokens") * 0.6).otherwise(0.0)
    score = share + F.when(F.col("category").isin("preference", "personal", "work"), 0.15).otherwise(0.0)
    score = score * F.when(F.col("confidence") == "high", 1.0).when(F.col("confidence") == "medium", 0.7).when(F.col("confidence") == "low", 0.4).otherwise(0.5)
    hours = (F.lit(as_of_ms) - F.col("ts_ms")) / 3_600_000
    score = score + F.when(hours < 24, 0.1).otherwise(0.0) + F.when(hours < 1, 0.05).otherwise(0.0)
    # the threshold after the top few, so that no filter runs the tokenizer a second time
    top = rows.withColumn("score", F.round(score, 6)).orderBy(F.desc("score"), "id").limit(most).where(F.col("score") >= threshold)
    place = F.row_number().over(Window.orderBy(F.desc("score"), "id"))
    whole = Window.partitionBy(F.lit(1))
    line = F.length("content") + 2 + F.when(F.col("confidence").isNotNull(), F.length("confidence") + 3).otherwise(0)
    # the block: a first and a last line around the facts' lines
    sized = top.withColumns({"place": place, "n": F.count("*").over(whole), "size": F.sum(line).over(whole)})
    tokens_used = F.ceil((F.col("size") + F.col("n") - 1 + 34) / 4)
    return sized.where((tokens_used <= budget) | (F.col("place") <= F.greatest(F.lit(3), F.col("n") - 2))).select("id", "score")
