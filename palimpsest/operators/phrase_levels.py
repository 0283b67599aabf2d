"""Phrases that recur, mined level by level.

``phrases.phrase_counts`` sends every phrase of every text to the exchange, though most occur once.
Here a phrase is put together only when all shorter ones in it recur: each level counts the hashes
of its grams in the slots of a table of ``slots`` (the rule of Park, Chen and Yu), whose bits say
what may recur, and a gram of the next level counts only where the bits of both grams in it are set.
A slot that several grams share lets too many through and none is lost; the last step counts what
is left as whole strings, so the rows are those of ``phrase_counts`` at every size of the table.
What is exchanged at a level is at most a number and a count for each slot and task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.text import PHRASE_STOP_WORDS
from palimpsest.operators.phrases import word_rows
from palimpsest.plans.steps import materialised

LEAST_SLOTS, MOST_SLOTS = 1 << 15, 1 << 25


def _slot(at: Column, n: int, slots: int) -> Column:
    """Slot of the gram of ``n`` words from a place (0: the first); any number where there is none."""
    return F.pmod(F.xxhash64(F.lit(n), *[F.get("w", at + k) for k in range(n)]), F.lit(slots))


def _there(at: Column, n: int) -> Column:
    return F.get("w", at + (n - 1)).isNotNull()


def _set(table: Column, slot: Column) -> Column:
    return F.getbit(F.get(table, F.shiftright(slot, 6).cast("int")), slot.bitwiseAND(F.lit(63)).cast("int")) == 1


def _table(found: DataFrame, slots: int, least_freq: int) -> DataFrame:
    """One stored row of ``slots`` bits: those of the slots that ``least_freq`` rows of ``found`` (slot) have."""
    many = found.groupBy("slot").agg(F.count("*").alias("n")).where(F.col("n") >= least_freq)
    words = many.groupBy(F.shiftright("slot", 6).alias("id")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(slot % 64 AS INT))")).alias("bits"))
    every = found.sparkSession.range(slots // 64).join(words, "id", "left").select("id", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"))
    return materialised(every.agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "bits"))), lambda x: x["bits"]).alias("bits")))


def mined_phrases(texts: DataFrame, shortest: int = 2, longest: int = 6, least_freq: int = 2, least_convs: int = 1, slots: int | None = None) -> DataFrame:
    """phrase, freq, n_convs as ``phrases.phrase_counts`` has them; ``shortest`` is 2 or more.

    ``slots``: a power of two, 64 or more; None: some four for each word, from 32,768 to 33,554,432
    (a table of 4 MB, which every task holds).  The texts' words are stored once and read once a level.
    """
    if shortest < 2 or (slots is not None and (slots < 64 or slots & (slots - 1))):
        raise ValueError("phrases have two words or more, and slots are a power of two, 64 or more")
    rows = materialised(word_rows(texts, longest))
    if slots is None:
        total = rows.agg(F.sum("own")).first()[0] or 0
        slots = min(MOST_SLOTS, max(LEAST_SLOTS, 1 << (4 * total).bit_length()))
    at = F.col("at")
    begins = rows.select("conv_id", "w", F.explode(F.sequence(F.lit(0), F.col("own") - 1)).alias("at"))
    tables: dict[int, DataFrame] = {}

    def may_recur(n: int, shift: int = 0) -> Column:
        return _set(tables[n].scalar(), _slot(at + shift, n, slots))

    for n in range(2, longest + 1):
        whole = begins.where(_there(at, n))
        if n > 2:
            whole = whole.where(may_recur(n - 1) & may_recur(n - 1, 1))
        tables[n] = _table(whole.select(_slot(at, n, slots).alias("slot")), slots, least_freq)
    # the longest gram from a place that may recur; each level is looked up once, and the first that can't ends the search
    longest_able = F.when(~_there(at, 2) | ~may_recur(2), 1)
    for n in range(3, longest + 1):
        longest_able = longest_able.when(~_there(at, n) | ~may_recur(n), n - 1)
    longest_able = longest_able.otherwise(longest)
    lengths = F.slice(F.array(*[F.lit(n) for n in range(shortest, longest + 1)]), F.lit(1), F.greatest(F.lit(0), longest_able - (shortest - 1)))
    grams = begins.where(~F.get("w", at).isin(PHRASE_STOP_WORDS)).select("conv_id", "w", "at", F.explode(lengths).alias("n"))
    found = grams.where(~F.get("w", at + F.col("n") - 1).isin(PHRASE_STOP_WORDS)).select("conv_id", F.array_join(F.slice("w", at + 1, F.col("n")), " ").alias("phrase")).where(F.length("phrase") >= 6)
    per = found.groupBy("phrase", "conv_id").agg(F.count("*").alias("n"))
    return per.groupBy("phrase").agg(F.sum("n").alias("freq"), F.count("*").alias("n_convs")).where((F.col("freq") >= least_freq) & (F.col("n_convs") >= least_convs))
