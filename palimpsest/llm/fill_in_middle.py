"""Fill-in-the-middle: a text's prefix, middle and suffix, moved behind sentinels.

A text is cut into units that end with one of a few ASCII characters (lines: with a line feed), the last
one perhaps without; or each character is a unit.  One Aho-Corasick automaton knows those characters
and the sentinels and goes once over a text; all it reports are the places where something changes.
Between two of them the units are a matter of arithmetic (none is complete, or each character is
one), so these places are all that is kept, and the end of the n-th unit is looked up by rank among them.  A text in which a sentinel occurs stays as it is.

Where the middle lies and which form a text takes follow from its doc_id and the seed alone: the
first four groups of eight hex digits of sha256("seed:doc_id") as numbers h1 to h4.  The
prefix ends after the smaller of h1 and h2 modulo (units + 1) units, the middle after the larger;
a text is rearranged if h3 modulo 100 is below ``percent``, suffix first (spm) if h4 modulo 100 is below
``suffix_first``, else prefix first (psm).  ``restored`` is the way back.

Null text is empty and stays plain; so does any empty text.  A null doc_id counts as an empty string
in the hash.  Rows are independent: repeated ones come out alike.  Texts may be of any length that a row
holds; the events of one text are in memory at a time.  Further columns pass through, whatever their
names; what this adds replaces columns of its own names (ADDED).  An empty table gives no rows.
"""

from __future__ import annotations

import functools
import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from palimpsest.llm.shared import read_table, small

#: What ends a unit; an empty string: each character is one.
UNITS = {"lines": "\n", "words": " \t\n\v\f\r", "sentences": ".!?\n", "characters": ""}
SENTINELS = ("<P>", "<S>", "<M>")
ADDED = {"n": "long", "form": "string", "prefix_chars": "long", "middle_chars": "long", "output": "string"}


class Units:
    """Finds units and sentinels of texts."""

    def __init__(self, ends: str, sentinels: tuple[str, str, str]):
        import ahocorasick

        first = {s[:1] for s in sentinels}
        if len(set(sentinels)) < 3 or any(not s or any(c in first for c in s[1:]) for s in sentinels) or any(s in t for s in sentinels for t in sentinels if s != t):
            raise ValueError("sentinels must differ, and where one begins no other may have begun")
        self.each = not ends
        self.automaton = ahocorasick.Automaton()
        for c in ends:
            self.automaton.add_word(c, 1)
        for s in sentinels:
            self.automaton.add_word(s, 0)
        self.automaton.make_automaton()

    def events(self, text: str) -> list[int] | None:
        """Places after the characters at which a unit ends, in order; None if the text has a sentinel."""
        ends = []
        for at, one in self.automaton.iter(text):
            if not one:
                return None
            ends.append(at + 1)
        return ends

    def count(self, text: str, ends: list[int]) -> int:
        """Units of the text: those that end at events, and what is left behind the last."""
        if self.each:
            return len(text)
        return len(ends) + (len(text) > (ends[-1] if ends else 0))

    def place(self, text: str, ends: list[int], units: int) -> int:
        """Where the first ``units`` units end."""
        if self.each:
            return units
        # each event ends one unit, so the n-th unit is looked up by its rank among the events
        return 0 if not units else ends[units - 1] if units <= len(ends) else len(text)


@functools.lru_cache(maxsize=8)
def finder(ends: str, sentinels: tuple[str, str, str]) -> Units:
    return Units(ends, sentinels)


def draws(seed: int, doc_id) -> list[int]:
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]


def rearranged(text: str, doc_id, units: Units, sentinels: tuple[str, str, str], seed: int, percent: int, suffix_first: int) -> tuple:
    """Values of ADDED for one text."""
    ends = units.events(text)
    n = units.count(text, ends if ends is not None else _all_ends(units, text))
    h1, h2, h3, h4 = draws(seed, doc_id)
    if not text or ends is None or h3 % 100 >= percent:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    lo, hi = units.place(text, ends, a), units.place(text, ends, b)
    p, s, m = sentinels
    if h4 % 100 < suffix_first:
        return n, "spm", lo, hi - lo, "".join((s, text[hi:], p, text[:lo], m, text[lo:hi]))
    return n, "psm", lo, hi - lo, "".join((p, text[:lo], s, text[hi:], m, text[lo:hi]))


def _all_ends(units: Units, text: str) -> list[int]:
    return [at + 1 for at, one in units.automaton.iter(text) if one]


def fill_in_middle(docs: DataFrame, unit: str = "lines", sentinels: tuple[str, str, str] = SENTINELS, seed: int = 7, percent: int = 100, suffix_first: int = 50) -> DataFrame:
    """``docs`` (doc_id, text, ...) with n, form, prefix_chars, middle_chars and output.

    ``sentinels`` stand before prefix, suffix and middle.
    """
    ends = UNITS[unit]
    finder(ends, sentinels)  # a wrong choice is an error here, not in a task
    # a row goes as one value, so that its columns may have any name
    whole = docs.drop(*ADDED).select(F.struct("*").alias("row"))
    kinds = {k: StringType() if v == "string" else LongType() for k, v in ADDED.items()}
    out = StructType([*whole.schema, *(StructField(k, v) for k, v in kinds.items())])

    def run(batches):
        units = finder(ends, sentinels)
        for b in small(batches, 200):
            row = b.column("row")
            rows = [rearranged(t or "", d, units, sentinels, seed, percent, suffix_first) for d, t in zip(row.field("doc_id").to_pylist(), row.field("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([row, *(pa.array(c, pa.string() if v == "string" else pa.int64()) for c, v in zip(zip(*rows), ADDED.values()))], ["row", *ADDED])

    return whole.mapInArrow(run, out).select("row.*", *ADDED)


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that became ``output``; it holds each sentinel once, unless its form is plain."""
    p, s, m = (F.lit(x) for x in sentinels)
    chars = lambda x: F.length(x)
    piece = lambda a, b: F.substring(output, a, b - a)
    at = {k: F.locate(x, output) for k, x in zip("psm", sentinels)}
    end = F.length(output) + 1
    psm = F.concat(piece(at["p"] + chars(p), at["s"]), piece(at["m"] + chars(m), end), piece(at["s"] + chars(s), at["m"]))
    spm = F.concat(piece(at["p"] + chars(p), at["m"]), piece(at["m"] + chars(m), end), piece(at["s"] + chars(s), at["p"]))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_in_middle(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


OP13_SQL = """WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\n]*\\n|[^\\n]+') AS lines, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS digest FROM documents
), h AS (
  SELECT doc_id, text, lines, len(lines) AS n, CAST('0x' || digest[1:8] AS BIGINT) AS h1, CAST('0x' || digest[9:16] AS BIGINT) AS h2, CAST('0x' || digest[17:24] AS BIGINT) AS h3, CAST('0x' || digest[25:32] AS BIGINT) AS h4 FROM d
), c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM h
), p AS (
  SELECT *, array_to_string(list_slice(lines, 1, a), '') AS prefix, array_to_string(list_slice(lines, a + 1, b), '') AS middle, array_to_string(list_slice(lines, b + 1, n), '') AS suffix FROM c
), o AS (
  SELECT *, CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END AS output FROM p)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(output) AS output_sha256, sha256(text) AS restored_sha256 FROM o"""
