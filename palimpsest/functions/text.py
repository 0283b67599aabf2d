"""Column functions over message text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that the retrieval tokenizer leaves out.
STOP_WORDS = [
    "a", "an", "the", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "from", "is", "are", "was", "were", "be", "been",
    "being", "have", "has", "had", "do", "does", "did", "will", "would", "could", "should", "may", "might", "shall", "can", "this", "that", "these",
    "those", "i", "you", "he", "she", "we", "they", "it", "my", "your", "his", "her", "our", "their", "its", "me", "him", "us", "them", "what",
    "which", "who", "when", "where", "how", "why", "not", "no", "so", "if", "as", "up", "out", "about", "into", "than", "then", "too", "very", "just",
    "also", "more", "some", "all", "any", "each", "most", "other", "such", "same", "get", "got", "make", "made", "go", "going", "know", "think",
    "see", "look", "want", "use", "need", "like", "time", "way", "even", "here", "there",
]

# Words that may not begin or end a mined phrase.
PHRASE_STOP_WORDS = [
    "the", "a", "an", "is", "are", "was", "were", "be", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "from", "this", "that",
    "it",
]


def retrieval_tokens(text: Column) -> Column:
    """Lower-case words of letters, digits, ``_`` and ``-``, of two characters or more, without stop words."""
    words = F.split(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z0-9\s_-]", " "), r"\s+")
    return F.filter(words, lambda w: (F.length(w) > 1) & ~_is_stop_word(w))


def _is_stop_word(w: Column) -> Column:
    """A word is only compared with the stop words of its length."""
    found = F.lit(False)
    for n in sorted({len(s) for s in STOP_WORDS}):
        found = F.when(F.length(w) == n, F.array_contains(F.array(*[F.lit(s) for s in STOP_WORDS if len(s) == n]), w)).otherwise(found)
    return found


def relevance_tokens(text: Column) -> Column:
    """Lower-case words of letters and digits, of three characters or more."""
    words = F.split(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z0-9\s]", " "), r"\s+")
    return F.filter(words, lambda w: F.length(w) > 2)


def truncated(text: Column, n: int) -> Column:
    """Texts over n characters end in ``...`` within n."""
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n - 3), F.lit("..."))).otherwise(text)


def token_estimate(length: Column) -> Column:
    return F.ceil(length / 4).cast("long")


def phrase_token_estimate(length: Column) -> Column:
    """As ``token_estimate``, at least 1."""
    return F.greatest(F.lit(1).cast("long"), token_estimate(length))


def normal_role(role: Column) -> Column:
    r = F.lower(role)
    return F.when(r.isin("human", "user"), "user").when(r == "system", "system").otherwise("assistant")


def _decimals(x: Column, n: int) -> Column:
    """With n decimals, halves rounded up."""
    return F.format_string(f"%.{n}f", F.floor(x * 10**n + 0.5) / 10**n)


def short_number(n: Column) -> Column:
    """1,234 as 1.2K, 2,500,000 as 2.5M."""
    return (
        F.when(n >= 1_000_000, F.concat(_decimals(n / 1_000_000, 1), F.lit("M")))
        .when(n >= 1_000, F.concat(_decimals(n / 1_000, 1), F.lit("K")))
        .otherwise(n.cast("long").cast("string"))
    )


def cost_dollars(tokens_in: Column, tokens_out: Column) -> Column:
    return (tokens_in * 3 + tokens_out * 15) / 1_000_000


def cost_label(cost: Column) -> Column:
    return F.when(cost < 0.001, "<$0.01").otherwise(F.concat(F.lit("$"), _decimals(cost, 3)))


def percent(saved: Column, raw: Column) -> Column:
    """Rounded percentage; null if there is nothing to compare with."""
    return F.when(raw > 0, F.floor(saved * 100 / raw + 0.5).cast("long"))


def age_label(minutes: Column) -> Column:
    """Minutes, hours or days ago."""
    rounded = lambda c: F.floor(c + 0.5).cast("long").cast("string")
    return (
        F.when(minutes < 60, F.concat(rounded(minutes), F.lit("m ago")))
        .when(minutes < 1440, F.concat(rounded(minutes / 60), F.lit("h ago")))
        .otherwise(F.concat(rounded(minutes / 1440), F.lit("d ago")))
    )


# Pairs of markers around context that an earlier turn was given; a host adds its own.
CONTEXT_MARKERS = [
    ("[MEMORY CONTEXT]", "[END MEMORY CONTEXT]"),
    ("<memory_context>", "</memory_context>"),
    ("<retrieved_context>", "</retrieved_context>"),
    ("--- SESSION CONTEXT ---", "--- END SESSION CONTEXT ---"),
    ("--- RELEVANT CONTEXT ---", "--- END RELEVANT CONTEXT ---"),
]


def _quoted(text: str) -> str:
    return "".join("\\" + c if c in r"\.[]{}()*+?^$|<>-" and c not in "<>-" else c for c in text)


def context_pattern(begin: str, end: str) -> str:
    return f"(?s){_quoted(begin)}.*?{_quoted(end)}\n*"


def without_context(text: Column, markers=CONTEXT_MARKERS) -> Column:
    for begin, end in markers:
        text = F.regexp_replace(text, context_pattern(begin, end), "")
    return F.trim(text)


def has_context(text: Column, markers=CONTEXT_MARKERS) -> Column:
    """Whether a message carries a block already, so that none is put into it twice."""
    found = F.lit(False)
    for begin, _ in markers:
        found = found | text.contains(begin)
    return F.coalesce(found, F.lit(False))


def last_sentences(text: Column) -> Column:
    """A search query from a message: its last two sentences, 200 characters at most, dashed blocks left out."""
    clean = F.trim(F.regexp_replace(text, "(?s)---.*?---", ""))
    parts = F.split(clean, r"(?<=[.!?])\s+")
    return F.substring(F.array_join(F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), 2), " "), 1, 200)
