"""Small tables with what real ones hold now and then, and plain versions of the operators' rules."""

import random
import re

WORDS = ["thing", "other", "Data", "river", "stone", "größe", "été", "42", "model", "token", "graph", "night", "Blue", "paper"]
SCHEMA = "doc_id long, text string, lang string, shard int, fp long, digest binary, row long, part int, window string, root long, n_chars long"


def documents(seed=0, n=40):
    """(doc_id, text): nulls, empty and long texts, copies, near copies, shared passages, repeated rows, junk."""
    rnd = random.Random(seed)
    prose = lambda k: " ".join(rnd.choice(WORDS) + rnd.choice(["", "", ",", "."]) for _ in range(k))
    passage, long = prose(30), prose(4000)
    rows = [(0, None), (1, ""), (2, " \n\t "), (3, long), (4, long), (5, long.replace("river", "rivers", 3)), (6, "one two"), (7, "the " * 80), (8, "a<|endoftext|>b  c\n\nd")]
    for i in range(9, n):
        t = prose(rnd.randint(1, 120))
        if i % 3 == 0:
            t = t[: len(t) // 2] + " " + passage + " " + t[len(t) // 2 :]
        if i % 7 == 0:
            t = rows[rnd.randrange(9, i)][1] if i > 9 else t
        if i % 11 == 0:
            t = t.upper().replace(" ", "!! ") + "\n" + t + "\n" + t
        rows.append((i, t))
    rows += [rows[12], rows[3], (n, rows[12][1])]
    rnd.shuffle(rows)
    return rows


def frame(spark, rows):
    """The rows with further columns whose names the operators use inside."""
    return spark.createDataFrame([(d, t, "en", 1, 2, b"x", 3, 4, "w", 5, len(t or "")) for d, t in rows], SCHEMA)


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def bench_words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))


def space_words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")
