"""Rule-based shortening of prompts, its dictionary form and its way back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Phrases and what stands for them, in order; case is ignored.
PHRASES = [
    ("let me know if you have any questions", ""),
    ("feel free to ask if you need", ""),
    ("would you like me to", "shall I"),
    ("it's important to note that", "note:"),
    ("it is important to note that", "note:"),
    ("it's worth noting that", "note:"),
    ("I would recommend", "I recommend"),
    ("I'd recommend", "I recommend"),
    ("I've successfully", ""),
    ("has been successfully", ""),
    ("in addition to", "plus"),
    ("as well as", "and"),
    ("in order to", "to"),
    ("for example", "e.g."),
    ("for instance", "e.g."),
    ("as a result", "so"),
    ("additionally", "also"),
    ("furthermore", "also"),
    ("hope this helps", ""),
    ("I'd be happy to", "I can"),
    ("feel free to", ""),
]

# Words that go, and words with an abbreviation; whole words, case is ignored.
FILLERS = ["essentially", "basically", "actually", "honestly"]
ABBREVIATIONS = [
    ("implementation", "impl"),
    ("infrastructure", "infra"),
    ("configuration", "config"),
    ("environment", "env"),
    ("authentication", "auth"),
    ("documentation", "docs"),
    ("requirements", "reqs"),
    ("dependencies", "deps"),
    ("performance", "perf"),
    ("approximately", "approx"),
]

#: (pattern, replacement) of the fixed part; the same text is right for Java and RE2.
STATIC_RULES = (
    [(f"(?i){p}", r) for p, r in PHRASES]
    + [(rf"(?i)\b{w}\b\s*,?\s*", "") for w in FILLERS]
    + [(rf"(?i)\b{w}\b", r) for w, r in ABBREVIATIONS]
)


def compressed(text: Column, symbols: list[tuple[str, str]] = ()) -> Column:
    """Texts of 30 characters or more by the fixed rules, then (phrase, symbol) pairs, longest phrase first."""
    out = text
    for pattern, by in STATIC_RULES:
        out = F.regexp_replace(out, pattern, by)
    for phrase, symbol in sorted(symbols, key=lambda s: -len(s[0])):
        out = F.regexp_replace(out, rf"(?i)\Q{phrase}\E", symbol.replace("$", r"\$"))
    out = F.regexp_replace(F.trim(F.regexp_replace(out, r"\s+", " ")), r" +([.,;:])", "$1")
    return F.when(F.length(text) < 30, text).otherwise(out)


def expanded(text: Column, symbols: list[tuple[str, str]]) -> Column:
    """Symbols before white space, a mark or the end become their phrases."""
    for phrase, symbol in symbols:
        text = F.regexp_replace(text, rf"\Q{symbol}\E(?=[\s.,;:!?]|$)", phrase.replace("$", r"\$"))
    return text


# The lines that tell a reader how to answer and what the symbols stand for.
SPEC_HEAD = [
    "--- CMPRS ---",
    "Respond concisely. Skip filler phrases.",
    "DROP: essentially, basically, actually, hope this helps, it's worth noting, I'd be happy to",
    "ABR: info config app env docs impl reqs deps perf auth auto comms org fn svc param",
]
SPEC_USE = "USE: replace above phrases with their § code in your responses."
SPEC_TAIL = ["RULE: terse prose. no filler. code unchanged.", "--- END ---"]


def spec_block(symbols: list[tuple[str, str]], most: int = 20) -> str:
    """The block that goes before a shortened message, with the first ``most`` (phrase, symbol) pairs."""
    known = ["SYMBOLS: " + " ".join(f"{s}={p}" for p, s in symbols[:most]), SPEC_USE] if symbols else []
    return "\n".join([*SPEC_HEAD, *known, *SPEC_TAIL])


def spec_of(symbols: DataFrame, *order: str | Column, most: int = 20) -> DataFrame:
    """One row, block: ``spec_block`` of the first ``most`` entries (symbol, phrase) of a dictionary in an order, also of an empty one."""
    top = symbols.orderBy(*order, "symbol").limit(most)
    ranked = top.select(F.struct(F.row_number().over(Window.orderBy(*order, "symbol")).alias("at"), F.concat("symbol", F.lit("="), "phrase").alias("line")).alias("x"))
    lines = ranked.agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]), " ").alias("lines"))
    known = F.when(F.col("lines") != "", F.concat(F.lit("SYMBOLS: "), "lines", F.lit(f"\n{SPEC_USE}\n"))).otherwise("")
    return lines.select(F.concat(F.lit("\n".join(SPEC_HEAD) + "\n"), known, F.lit("\n".join(SPEC_TAIL))).alias("block"))
