"""Entities and relations of facts, and bounded walks over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.plans.steps import materialised

# Patterns of entities, in order: (pattern, type, prefix of the key, least length).
ENTITY_PATTERNS = [
    (r"(?i)\b(docker|kubernetes|k8s|nginx|traefik|postgres|postgresql|sqlite|redis|minio|n8n|ollama|llama|claude|openai|anthropic|chromium|chrome)\b", "tool", "", 0),
    (r"(?i)\b(vps[1-9]?|vps2|vps1|homelab|raspberry ?pi|ubuntu|debian|windows|macos)\b", "location", "", 0),
    (r"\b([A-Z][a-z]+(?:[A-Z][a-z]+)+|[a-z]+-[a-z]+-[a-z]+)\b", "project", "", 6),
    (r"(?i)\bv(\d+\.\d+\.\d+(?:-[a-z]+)?)\b", "concept", "version:", 0),
    (r"(?i)\bport (\d{2,5})\b", "concept", "port:", 0),
    (r"/opt/projects/([\w-]+)", "project", "path:", 0),
]

# Patterns of relations from a fact's first entity; group 1 is the target.
RELATION_PATTERNS = [
    (r"(?i)uses?\s+([\w.-]+)", "USES"),
    (r"(?i)runs?\s+on\s+([\w.-]+)", "RUNS_ON"),
    (r"(?i)works?\s+on\s+([\w.-]+)", "WORKS_ON"),
    (r"(?i)prefers?\s+([\w.-]+)", "PREFERS"),
    (r"(?i)depends?\s+on\s+([\w.-]+)", "DEPENDS_ON"),
    (r"(?i)part\s+of\s+([\w.-]+)", "PART_OF"),
    (r"(?i)located?\s+(?:at|in)\s+([\w.-]+)", "LOCATED_AT"),
    (r"(?i)created?\s+by\s+([\w.-]+)", "CREATED_BY"),
    (r"(?i)([\w.-]+)\s+is\s+(?:a|the|an)\s+", "IS_A"),
]


def project_pattern(names: list[str]) -> tuple[str, str, str, int]:
    """A host's own project names, to be put before the third pattern."""
    return (r"\b(" + "|".join(names) + r")\b", "project", "", 0)


def domain_pattern(domain: str) -> tuple[str, str, str, int]:
    """Hosts below a domain of one's own, to be put after all other patterns."""
    return ("(?i)([a-z0-9-]+" + "".join("\\." + part for part in domain.split(".")) + ")", "location", "", 0)


def with_own(names: list[str] = (), domain: str | None = None) -> list[tuple[str, str, str, int]]:
    """The patterns with a host's own project names and domain among them."""
    own = [*ENTITY_PATTERNS[:2], *([project_pattern(list(names))] if names else []), *ENTITY_PATTERNS[2:]]
    return [*own, domain_pattern(domain)] if domain else own


def _found(text: Column, patterns) -> Column:
    """Array of (key, type, shown) in order of pattern and place."""
    every = []
    for pattern, kind, prefix, least in patterns:
        names = F.regexp_extract_all(text, F.lit(pattern), 1)
        names = F.filter(names, _at_least(least)) if least else names
        every.append(F.transform(names, _entity(kind, prefix)))
    return F.concat(*every)


def parsed(facts: DataFrame, patterns=ENTITY_PATTERNS) -> DataFrame:
    """``facts`` (id, content, ts_ms) with ``e``, their (name, type, shown), each key once, and ``said``, what their words say of the first entity.

    Each pattern runs once over a text: what it finds is folded in one expression, and a relation's
    target is taken from the few words that matched.
    """
    kind = "array<struct<key:string,type:string,shown:string>>"
    firsts = F.aggregate(_found(F.col("content"), patterns), F.array().cast(kind), lambda kept, x: F.when(F.exists(kept, lambda k: k["key"] == x["key"]), kept).otherwise(F.array_append(kept, x)))
    named = F.transform(firsts, lambda e: F.struct(F.trim(F.lower(e["shown"])).alias("name"), e["type"].alias("type"), e["shown"].alias("shown")))
    said = F.concat(*[F.transform(F.regexp_extract_all("content", F.lit(pattern), 0), _target(pattern, rel, n)) for n, (pattern, rel) in enumerate(RELATION_PATTERNS)])
    return facts.select("id", "content", "ts_ms", named.alias("e"), F.filter(said, lambda s: F.length(s["to"]) >= 2).alias("said"))


def _target(pattern: str, rel: str, n: int):
    return lambda m, i: F.struct((i + 100 * (n + 1)).alias("at"), F.trim(F.lower(F.regexp_extract(m, pattern, 1))).alias("to"), F.lit(rel).alias("rel"), m.alias("evidence"))


def _at_least(n: int):
    return lambda name: F.length(name) >= n


def _entity(kind: str, prefix: str):
    return lambda name: F.struct(F.concat(F.lit(prefix), F.lower(name)).alias("key"), F.lit(kind).alias("type"), name.alias("shown"))


def mentions(facts: DataFrame, patterns=ENTITY_PATTERNS) -> DataFrame:
    """fact_id, ts_ms, at, name, type, shown: entities in the order in which facts (id, content, ts_ms) bring them up, relation targets last."""
    own = F.transform("e", lambda x, i: F.struct(i.alias("at"), x["name"].alias("name"), x["type"].alias("type"), x["shown"].alias("shown")))
    targets = F.transform("said", lambda s: F.struct((s["at"] + 1000).alias("at"), s["to"].alias("name"), F.lit("concept").alias("type"), s["to"].alias("shown")))
    every = F.concat(own, F.when(F.size("e") > 0, targets).otherwise(F.slice(targets, 1, 0)))
    return parsed(facts, patterns).select(F.col("id").alias("fact_id"), "ts_ms", F.explode(every).alias("m")).select("fact_id", "ts_ms", "m.*")


def entities(facts: DataFrame, patterns=ENTITY_PATTERNS) -> DataFrame:
    """name, type, shown, mentions, first_seen, last_seen."""
    # numbers alone are kept for each group at first, by hash and without a sort: a task holds no more than there are names
    some = mentions(facts, patterns).groupBy("name", "type", "shown", "at").agg(F.min("fact_id").alias("fact_id"), F.count("*").alias("n"), F.min("ts_ms").alias("lo"), F.max("ts_ms").alias("hi"))
    first = F.struct("fact_id", "at")
    return some.groupBy("name").agg(
        F.min_by("type", first).alias("type"), F.min_by("shown", first).alias("shown"), F.sum("n").alias("mentions"), F.min("lo").alias("first_seen"), F.max("hi").alias("last_seen")
    )


def relation_rows(facts: DataFrame) -> DataFrame:
    """fact_id, ts_ms, at, from, to, rel, evidence, confidence: neighbours in a fact, then what its words say of the first entity."""
    near = F.when(F.size("e") >= 2, F.sequence(F.lit(1), F.size("e") - 1)).otherwise(F.array().cast("array<int>"))
    kind = "array<struct<at:int,from:string,to:string,rel:string,evidence:string,confidence:double>>"
    chain = F.transform(
        near,
        lambda i: F.struct(
            i.alias("at"), F.element_at("e", i)["name"].alias("from"), F.element_at("e", i + 1)["name"].alias("to"), F.lit("CO_OCCURS_WITH").alias("rel"),
            F.substring("content", 1, 100).alias("evidence"), F.lit(0.4).cast("double").alias("confidence"),
        ),
    ).cast(kind)
    explicit = F.transform(
        F.when(F.size("e") > 0, F.col("said")).otherwise(F.slice("said", 1, 0)),
        lambda s: F.struct(s["at"].alias("at"), F.get("e", F.lit(0))["name"].alias("from"), s["to"].alias("to"), s["rel"].alias("rel"), s["evidence"].alias("evidence"), F.lit(0.75).cast("double").alias("confidence")),
    ).cast(kind)
    every = parsed(facts).select(F.col("id").alias("fact_id"), "ts_ms", F.explode(F.concat(chain, explicit)).alias("r"))
    return every.select("fact_id", "ts_ms", "r.*")


def relations(facts: DataFrame) -> DataFrame:
    """from, to, rel, confidence, evidence, n: confidence is the first one's and 0.05 for each further one, 1 at most; evidence is the last."""
    # as in ``entities``; a task holds no more than there are different sentences
    some = relation_rows(facts).groupBy("from", "to", "rel", "confidence", "evidence", "at").agg(F.min("fact_id").alias("lo"), F.max("fact_id").alias("hi"), F.count("*").alias("n"))
    first, last = F.struct("lo", "at"), F.struct("hi", "at")
    grouped = some.groupBy("from", "to", "rel").agg(F.min_by("confidence", first).alias("c"), F.sum("n").alias("n"), F.max_by("evidence", last).alias("evidence"))
    confidence = F.round(F.least(F.lit(1.0), F.col("c") + (F.col("n") - 1) * 0.05), 6)
    return grouped.select("from", "to", "rel", confidence.alias("confidence"), "evidence", "n")


def seeds(ents: DataFrame, query: str) -> DataFrame:
    """Entities named in a query; if there are none, two for each word over three characters that holds or is held by a name."""
    low = query.lower()
    named = ents.where(F.lit(low).contains(F.col("name")))
    words = [w for w in low.split() if len(w) > 3]
    fuzzy = None
    for w in words:
        some = ents.where(F.col("name").contains(w) | F.lit(w).contains(F.col("name"))).orderBy("name").limit(2)
        fuzzy = some if fuzzy is None else fuzzy.unionByName(some)
    if fuzzy is None:
        return named
    none = named.agg(F.count("*").alias("named")).where("named = 0")
    return named.unionByName(fuzzy.dropDuplicates(["name"]).join(F.broadcast(none)).select(*ents.columns))


def walk_steps(start: DataFrame, rels: DataFrame, hops: int, least: float, by: list[str]) -> DataFrame:
    """``by``, name, hop: what is within ``hops`` of ``start`` (``by``, name) over relations of confidence ``least`` or more, either way."""
    strong = rels.where(F.col("confidence") >= least)
    edges = strong.select(F.col("from").alias("a"), F.col("to").alias("b")).unionByName(strong.select(F.col("to").alias("a"), F.col("from").alias("b"))).distinct()
    seen = start.select(*by, "name", F.lit(0).alias("hop")).distinct()
    frontier = seen
    for hop in range(1, hops + 1):
        reached = frontier.join(edges, F.col("name") == F.col("a")).select(*by, F.col("b").alias("name")).distinct()
        frontier = reached.join(seen.select(*by, "name"), [*by, "name"], "left_anti").withColumn("hop", F.lit(hop))
        seen = seen.unionByName(frontier)
    return seen


def walk(start: DataFrame, rels: DataFrame, hops: int = 2, least: float = 0.5) -> DataFrame:
    """name, hop: what is within ``hops`` of ``start`` (name) over relations of confidence ``least`` or more, either way."""
    return walk_steps(start, rels, hops, least, [])


def block(seen: DataFrame, ents: DataFrame, rels: DataFrame, hops: int = 2, most: int = 15, each: int = 4) -> DataFrame:
    """One row: the text that tells a reader about the entities of a walk, nearest first."""
    top = seen.join(ents, "name").orderBy("hop", "name").limit(most)
    strong = rels.where("confidence >= 0.5")
    out = strong.select(F.col("from").alias("name"), F.lit("→").alias("way"), "rel", F.col("to").alias("other"))
    back = strong.where(F.col("from") != F.col("to")).select(F.col("to").alias("name"), F.lit("←").alias("way"), "rel", F.col("from").alias("other"))
    lines = out.unionByName(back).join(top.where(F.col("hop") < hops).select("name"), "name", "left_semi")
    place = F.row_number().over(Window.partitionBy("name").orderBy("way", "rel", "other"))
    lines = lines.withColumn("place", place).where(F.col("place") <= each)
    lines = lines.groupBy("name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", F.concat(F.lit("\n  "), "way", F.lit(" "), "rel", F.lit(" "), "other").alias("line")))), lambda x: x["line"]), "").alias("lines"))
    head = F.concat(F.upper("type"), F.lit(": "), "shown", F.lit(" (seen "), F.col("mentions").cast("string"), F.lit("x)"), F.coalesce("lines", F.lit("")))
    rows = top.join(lines, "name", "left").select("hop", "name", head.alias("text"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("hop", "name", "text"))), lambda x: x["text"]), "\n")
    return rows.agg(F.concat(F.lit("[KNOWLEDGE GRAPH]\n"), body, F.lit("\n[/KNOWLEDGE GRAPH]")).alias("block"))


def stats(ents: DataFrame, rels: DataFrame) -> DataFrame:
    """kind, key, n: entities and relations by type."""
    return ents.groupBy(F.lit("entity").alias("kind"), F.col("type").alias("key")).agg(F.count("*").alias("n")).unionByName(
        rels.groupBy(F.lit("relation").alias("kind"), F.col("rel").alias("key")).agg(F.count("*").alias("n"))
    )


def top_entities(ents: DataFrame, n: int = 10) -> DataFrame:
    return ents.orderBy(F.desc("mentions"), "name").limit(n)


def layer(ents: DataFrame, rels: DataFrame, query: str, least: int = 50) -> DataFrame | None:
    """id, score, method of a walk from a query's entities; None if its block has no more than ``least`` characters."""
    seen = materialised(walk(seeds(ents, query), rels))
    text = block(seen, ents, rels).first()["block"]
    if text is None or len(text) <= least:
        return None
    return seen.select(F.col("name").alias("id"), (2 - F.col("hop")).alias("score"), F.lit("graph").alias("method"))
