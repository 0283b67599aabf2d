"""Phrases that recur in conversations, their value as dictionary entries, and the dictionary."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.text import PHRASE_STOP_WORDS, phrase_token_estimate

SPEC_BUDGET, SPEC_COST, SYMBOL_COST = 80, 3, 1
TASK_CHARS = 1 << 20  # a task's characters of text: the grams of them that it holds take some hundred times as many bytes


def word_rows(texts: DataFrame, longest: int) -> DataFrame:
    """conv_id, own, w: a turn's words and the first few of those after it in its conversation, which is gathered in no row; the first ``own`` begin grams."""
    clean = F.trim(F.regexp_replace(F.regexp_replace(F.lower("content"), r"[^a-z0-9\s'-]", " "), r"\s+", " "))
    order, whole = Window.partitionBy("conv_id").orderBy("turn"), Window.partitionBy("conv_id")
    size = F.sum(F.length("content") + 1).over(whole) - 1
    # texts are exchanged as they are: arrays of their words take several times the bytes
    # in as many parts as their characters ask for: by their few bytes, Spark would put them into few tasks
    parts = 1 + (texts.agg(F.sum(F.length("content"))).first()[0] or 0) // TASK_CHARS
    turns = texts.select("conv_id", "turn", "content").repartition(parts, "conv_id")
    turns = turns.select("conv_id", "turn", F.filter(F.split(clean, " "), lambda w: F.length(w) > 1).alias("w"), size.alias("size")).where("size >= 10 AND size(w) > 0")
    following = F.flatten(F.collect_list(F.slice("w", 1, longest - 1)).over(order.rowsBetween(1, longest - 1)))
    return turns.select("conv_id", F.size("w").alias("own"), F.concat("w", F.slice(following, 1, longest - 1)).alias("w"))


def phrase_counts(texts: DataFrame, shortest: int = 2, longest: int = 6, least_freq: int = 2, least_convs: int = 1) -> DataFrame:
    """phrase, freq, n_convs of word n-grams in ``texts`` (conv_id, turn, content); grams go from turn to turn of a conversation."""
    rows = word_rows(texts, longest)
    # rows of places and lengths, not arrays of phrases: the filters come before a phrase is put together
    begins = rows.select("conv_id", "w", F.explode(F.sequence(F.lit(1), F.col("own"))).alias("i")).where(~F.get("w", F.col("i") - 1).isin(PHRASE_STOP_WORDS))
    grams = begins.select("conv_id", "w", "i", F.explode(F.array(*[F.lit(n) for n in range(shortest, longest + 1)])).alias("n"))
    last = F.get("w", F.col("i") + F.col("n") - 2)
    found = grams.where(last.isNotNull() & ~last.isin(PHRASE_STOP_WORDS)).select("conv_id", F.array_join(F.slice("w", F.col("i"), F.col("n")), " ").alias("phrase")).where(F.length("phrase") >= 6)
    # two steps: a phrase's rows of one conversation meet before those of all
    per = found.groupBy("phrase", "conv_id").agg(F.count("*").alias("n"))
    return per.groupBy("phrase").agg(F.sum("n").alias("freq"), F.count("*").alias("n_convs")).where((F.col("freq") >= least_freq) & (F.col("n_convs") >= least_convs))


def candidates(counts: DataFrame) -> DataFrame:
    """phrase, freq, n_convs, tokens, value of phrases worth an entry."""
    tokens = phrase_token_estimate(F.length("phrase"))
    value = F.when(tokens > SYMBOL_COST, (tokens - SYMBOL_COST) * F.col("freq") - SPEC_COST).otherwise(F.lit(-1))
    return counts.withColumns({"tokens": tokens, "value": value}).where("value > 0")


def dictionary(found: DataFrame, budget: int = SPEC_BUDGET) -> DataFrame:
    """symbol, phrase, freq, value, spec_cost: best values first while the budget lasts; what does not fit is passed over.

    An entry costs 5 at least, so no more than budget // 5 of one cost can be taken: that many of
    each cost, a fixed number of rows, are all that the greedy pass reads.
    """
    cost = F.col("tokens") + SPEC_COST
    priced = found.withColumn("spec_cost", cost).where(F.col("spec_cost") <= budget)
    best = F.row_number().over(Window.partitionBy("spec_cost").orderBy(F.desc("value"), "phrase"))
    few = priced.withColumn("best", best).where(F.col("best") <= budget // 5).collect()
    left, used, rows = budget, set(), []
    for r in sorted(few, key=lambda r: (-r["value"], r["phrase"])):
        if r["spec_cost"] <= left:
            left -= r["spec_cost"]
            symbol = symbol_for(r["phrase"], used)
            used.add(symbol)
            rows.append((symbol, r["phrase"], r["freq"], r["value"], r["spec_cost"]))
    return found.sparkSession.createDataFrame(rows, "symbol string, phrase string, freq long, value long, spec_cost long")


def symbol_for(phrase: str, used: set[str]) -> str:
    """A short symbol from a phrase's letters that is not in use, else a number."""
    words = [w for w in phrase.split(" ") if len(w) > 1]
    tried = ["".join(w[0] for w in words)[:4], words[0][:3], "".join(w[0] for w in words[:3]), words[0][:2] + (words[1][0] if len(words) > 1 else "")]
    for t in tried:
        if t and f"§{t}" not in used:
            return f"§{t}"
    n = 1
    while f"§{n}" in used:
        n += 1
    return f"§{n}"


def by_frequency(symbols: DataFrame, n: int = 16) -> DataFrame:
    """The n most frequent entries of a dictionary."""
    return symbols.orderBy(F.desc(F.coalesce("freq", F.lit(0))), "symbol").limit(n)
