"""License scans by canonical digest, in DataFrame functions alone.

A text is brought to canonical form: copyright notices go, everything but letters, marks and digits
of any script becomes a space, letters become lower case and equivalent spellings of whole words
become one.  The SHA-256 of the whole canonical text is joined with the digests of known texts, which
come about in the same way; so is that of each canonical line, which finds notices within longer
documents.  Known texts are a parameter, (license_id, text), of any number: their digests are
broadcast, and beyond MOST_KEYS there is a pass over the documents for each MOST_KEYS of them.  A set
of common licenses comes with the package: short ones in ``KNOWN``, long ones as files in
``known_licenses``.

Whole known texts of LEAST_WORDS words or more are found within longer documents as well, wherever
they begin: each place of a document whose first, eighth and last of LEAST_WORDS words hash to a bit that a known
text has set is joined with the known texts by a hash of its LEAST_WORDS words, and the digest of as
many words as the known text has decides.

A line is a copyright notice if it begins, after marks of a comment, with "copyright" and a sign, a
number or a capitalised name, with "(c)" and a year, or with the sign, or if it says no more than "all rights
reserved".  Clause (c) of a license and lines of its body that begin with "copyright holders" and
the like stay.

Null text is canonically empty, and an empty canonical text is never a license.  Repeated rows
get a row each; if two known texts are canonically equal the least id stands; a text of any length is
held in memory some times over; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.decontamination import bit_table, table_slots, taken
from palimpsest.llm.shared import MOST_KEYS, ROW_KEY, read_table, stored, with_row_key

#: Known texts of fewer words are notices, which are looked up as lines.
LEAST_WORDS = 16

# Spellings that count as equal in license texts, and the one that stands.
SPELLINGS = [
    ("acknowledgment", "acknowledgement"), ("analogue", "analog"), ("analyse", "analyze"), ("artefact", "artifact"), ("authorisation", "authorization"),
    ("authorised", "authorized"), ("calibre", "caliber"), ("cancelled", "canceled"), ("capitalisation", "capitalization"), ("catalogue", "catalog"),
    ("categorise", "categorize"), ("centre", "center"), ("emphasised", "emphasized"), ("favour", "favor"), ("favourite", "favorite"),
    ("fulfil", "fulfill"), ("fulfilment", "fulfillment"), ("initialise", "initialize"), ("judgment", "judgement"), ("labelling", "labeling"),
    ("labour", "labor"), ("licence", "license"), ("maximise", "maximize"), ("modelled", "modeled"), ("modelling", "modeling"),
    ("offence", "offense"), ("optimise", "optimize"), ("organisation", "organization"), ("organise", "organize"), ("practise", "practice"),
    ("programme", "program"), ("realise", "realize"), ("recognise", "recognize"), ("signalling", "signaling"),
    ("utilisation", "utilization"), ("whilst", "while"), ("wilful", "willful"),
]
# Pairs of words that count as one word.
JOINED = [("sub license", "sublicense"), ("non commercial", "noncommercial"), ("per cent", "percent")]

# The same patterns are right for Java and RE2.  BODY_LINE marks lines that are no notices.
BODY_LINE = r"(^|\n)[ \t#*/;-]*((?i:copyright)[ \t]+(?i:holder|owner|notice|license|licence|law|statement|disclaimer))"
NOTICE_LINE = r"(^|\n)[ \t#*/;-]*(?:(?i:copyright)[ \t:,]+(?:(?i:\(c\))|©|[0-9]|[A-Z][a-z])[^\n]*|\([Cc]\)[ \t]*[0-9]{4}[^\n]*|©[^\n]*|(?i:all rights reserved)[ \t.\r]*(?m:$))"
OTHER = r"[^\p{L}\p{M}\p{N}\n]+"

# Whole texts and whole notices of common licenses.
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

"""
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""

KNOWN = [
    ("MIT", """MIT License

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("0BSD", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("Zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution."""),
    ("BSD-2-Clause", _BSD + _BSD_END),
    ("BSD-3-Clause", _BSD + """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.

""" + _BSD_END),
    ("MIT-0", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("BSL-1.0", """Boost Software License - Version 1.0 - August 17th, 2003

Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:

The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("Unlicense", """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <https://unlicense.org>"""),
    ("Apache-2.0 notice", "Licensed under the Apache License, Version 2.0."),
    ("CC-BY-NC-4.0 notice", "Licensed under CC BY-NC 4.0."),
    ("GPL-3.0 notice", "This work is licensed under the GNU General Public License, version 3."),
    ("MIT notice", "Released under the MIT License."),
]

#: Title lines that a copy may have or lack.
TITLES = {
    "MIT": ["MIT License", "The MIT License", "The MIT License (MIT)"], "ISC": ["ISC License", "The ISC License"],
    "0BSD": ["BSD Zero Clause License", "Zero-Clause BSD", "Zero-Clause BSD License"], "Zlib": ["zlib License", "The zlib License"],
    "BSD-2-Clause": ["BSD 2-Clause License", "The 2-Clause BSD License"], "BSD-3-Clause": ["BSD 3-Clause License", "The 3-Clause BSD License"],
    "MIT-0": ["MIT No Attribution"], "BSL-1.0": ["Boost Software License - Version 1.0 - August 17th, 2003"], "Unlicense": ["The Unlicense"],
}

#: Where an appendix begins that a copy may lack.
APPENDICES = {"Apache-2.0": "APPENDIX: How to apply", "GPL-2.0": "How to Apply These Terms", "GPL-3.0": "How to Apply These Terms", "LGPL-2.1": "How to Apply These Terms", "MPL-2.0": "Exhibit A - Source"}


def titled(known: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """``known`` with each license under all of its titles and under none, and with and without its appendix."""
    out = list(known)
    for name, text in known:
        body = next((text[len(t) :] for t in TITLES.get(name, ()) if text.startswith(t + "\n")), text)
        out += [(name, f"{t}\n{body}") for t in ["", *TITLES.get(name, ())]]
        if APPENDICES.get(name, "\0") in text:
            out.append((name, text[: text.index(APPENDICES[name])]))
    return out


@functools.cache
def common_licenses() -> list[tuple[str, str]]:
    """(license_id, text) of ``KNOWN`` and of the files in ``known_licenses``, in all their forms."""
    files = sorted((Path(__file__).parent / "known_licenses").glob("*.txt"))
    return titled(KNOWN + [(f.stem, f.read_text(encoding="utf-8")) for f in files])


def _spaced(text: Column) -> Column:
    """Lower-case words with a space of their own on each side; line feeds stay."""
    body = F.regexp_replace(F.coalesce(text, F.lit("")), BODY_LINE, "$1\u0001$2")
    body = F.regexp_replace(F.regexp_replace(body, NOTICE_LINE, "$1"), OTHER, "  ")
    return F.concat(F.lit(" "), F.lower(F.replace(body, F.lit("\n"), F.lit(" \n "))), F.lit(" "))


def canonical_lines(text: Column) -> Column:
    """A text's canonical lines, empty ones left out."""
    body = _spaced(text)
    for have, want in SPELLINGS:
        body = F.replace(body, F.lit(f" {have} "), F.lit(f" {want} "))
    body = F.regexp_replace(body, " +", " ")
    return F.filter(F.transform(F.split(body, "\n"), lambda x: F.trim(x)), lambda x: x != "")


def joined(words: Column) -> Column:
    body = F.concat(F.lit(" "), words, F.lit(" "))
    for have, want in JOINED:
        body = F.replace(body, F.lit(f" {have} "), F.lit(f" {want} "))
    return F.trim(body)


def canonical(text: Column) -> Column:
    return joined(F.array_join(canonical_lines(text), " "))


def _digest(form: Column) -> Column:
    return F.sha2(form.cast("binary"), 256)


def _head(words: Column, at: Column) -> Column:
    """Hash of three of the LEAST_WORDS words from a place."""
    return F.xxhash64(*[F.get(words, at + k) for k in (0, 7, LEAST_WORDS - 1)])


def _start(words: Column, at: Column) -> Column:
    return F.xxhash64(F.slice(words, at + 1, LEAST_WORDS))


def _met(docs: DataFrame, known: DataFrame) -> DataFrame:
    """Of ``docs`` (doc_id, ROW_KEY, lines, form): a row for each whole text, and for each line and block that is one of ``known``.

    Place -1 stands for the whole text, smaller ones for its lines and others for its words; all are
    made and tested in one pass, and what is none of ``known`` goes no further.
    """
    at, words = F.col("at"), F.col("words")
    cut = known.select(F.col("license_id").alias("block_id"), F.col("digest").alias("block"), F.split("form", " ").alias("words")).where(F.size("words") >= LEAST_WORDS)
    long = stored(cut.select("block_id", "block", F.size("words").alias("n"), _head(words, F.lit(0)).alias("hash"), _start(words, F.lit(0)).alias("start")), "blocks")
    slots = table_slots(long.count())
    rows = docs.withColumn("words", F.split("form", " "))
    rows = rows.select("*", F.explode(F.sequence(-1 - F.size("lines"), F.greatest(F.lit(-1), F.size("words") - LEAST_WORDS))).alias("at"))
    rows = rows.where((at < 0) | taken(bit_table(long, slots).scalar(), _head(words, at), slots)) if slots else rows.where(at < 0)
    digest = F.when(at == -1, _digest(F.col("form"))).when(at < -1, _digest(joined(F.get("lines", -2 - at))))
    rows = rows.select("doc_id", *ROW_KEY, "words", "at", digest.alias("digest"), F.when(at >= 0, _start(words, at)).alias("start"))
    rows = rows.join(F.broadcast(known.select("digest", "license_id")), "digest", "left").join(F.broadcast(long.drop("hash")), "start", "left")
    held = (at >= 0) & (_digest(F.array_join(F.slice(words, at + 1, F.col("n")), " ")) == F.col("block"))
    rows = rows.where((at == -1) | F.col("license_id").isNotNull() | F.when(F.col("n").isNotNull(), held))
    return rows.select("doc_id", *ROW_KEY, "at", "digest", "license_id", "block_id")


def scan_licenses(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """doc_id, canonical_sha256, license_id of the whole text (null: none), notices, blocks, is_license of every row of ``docs`` (doc_id, text).

    ``notices``: the sorted license_ids of the lines that are known texts, joined by commas; ``blocks``:
    those of the known texts of LEAST_WORDS words or more that the text holds.
    """
    if known is None:
        known = docs.sparkSession.createDataFrame(common_licenses(), "license_id string, text string")
    known = known.select("license_id", canonical(F.col("text")).alias("form")).where("form <> ''")
    known = stored(known.groupBy(_digest(F.col("form")).alias("digest")).agg(F.min("license_id").alias("license_id"), F.first("form").alias("form")), "known")
    passes = max(1, -(-known.count() // MOST_KEYS))
    lines = with_row_key(docs).select("doc_id", *ROW_KEY, canonical_lines(F.col("text")).alias("lines"))
    lines = lines.select("*", joined(F.array_join("lines", " ")).alias("form"))
    met = _met(lines, known.where(F.pmod(F.xxhash64("digest"), F.lit(passes)) == 0))
    for i in range(1, passes):
        met = met.unionByName(_met(lines, known.where(F.pmod(F.xxhash64("digest"), F.lit(passes)) == i)))
    whole, line = F.col("at") == -1, F.col("at") < -1
    ids = lambda x: F.array_join(F.array_sort(F.collect_set(x)), ",")
    per = met.groupBy(*ROW_KEY, "doc_id").agg(
        F.max(F.when(whole, F.col("digest"))).alias("canonical_sha256"), F.max(F.when(whole, F.col("license_id"))).alias("license_id"),
        ids(F.when(line, F.col("license_id"))).alias("notices"), ids(F.col("block_id")).alias("blocks"),
    )
    return per.select("doc_id", "canonical_sha256", "license_id", "notices", "blocks", (F.col("license_id").isNotNull() | (F.col("notices") != "") | (F.col("blocks") != "")).alias("is_license"))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(read_table(spark, sf_dir, "documents"))


def _replaced(text: str, pairs) -> str:
    for have, want in pairs:
        text = f"replace({text}, ' {have} ', ' {want} ')"
    return text


def _lines_sql(text: str) -> str:
    body = rf"regexp_replace(coalesce({text}, ''), '{BODY_LINE}', '\1' || chr(1) || '\2', 'g')"
    body = rf"regexp_replace(regexp_replace({body}, '{NOTICE_LINE}', '\1', 'g'), '{OTHER}', '  ', 'g')"
    body = f"' ' || lower(replace({body}, chr(10), ' ' || chr(10) || ' ')) || ' '"
    body = f"regexp_replace({_replaced(f'({body})', SPELLINGS)}, ' +', ' ', 'g')"
    return f"list_filter(list_transform(string_split({body}, chr(10)), lambda x: trim(x)), lambda x: x <> '')"


def _joined_sql(words: str) -> str:
    return f"trim({_replaced(f'concat(chr(32), {words}, chr(32))', JOINED)})"


OP4_SQL = f"""
WITH known(license_id, text) AS (VALUES {", ".join("('%s', '%s')" % (a, b.replace("'", "''")) for a, b in common_licenses())}
), forms AS (
  SELECT form, min(license_id) AS license_id
  FROM (SELECT license_id, {_joined_sql(f"array_to_string({_lines_sql('text')}, ' ')")} AS form FROM known) WHERE form <> '' GROUP BY 1
), digests AS (
  SELECT sha256(form) AS digest, license_id FROM forms
), lines AS (
  SELECT doc_id, {_lines_sql("text")} AS l FROM documents
), notices AS (
  SELECT doc_id, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS notices
  FROM (SELECT doc_id, unnest(l) AS x FROM lines) JOIN digests ON digest = sha256({_joined_sql("x")}) GROUP BY doc_id
), rows AS (
  SELECT doc_id, {_joined_sql("array_to_string(l, ' ')")} AS body FROM lines
), blocks AS (
  SELECT doc_id, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS blocks
  FROM rows JOIN forms ON contains(' ' || body || ' ', ' ' || form || ' ') WHERE len(string_split(form, ' ')) >= {LEAST_WORDS} GROUP BY doc_id
)
SELECT doc_id, sha256(body) AS canonical_sha256, license_id, coalesce(notices, '') AS notices, coalesce(blocks, '') AS blocks,
       license_id IS NOT NULL OR notices IS NOT NULL OR blocks IS NOT NULL AS is_license
FROM rows LEFT JOIN digests ON digest = sha256(body) LEFT JOIN notices USING (doc_id) LEFT JOIN blocks USING (doc_id)
"""
