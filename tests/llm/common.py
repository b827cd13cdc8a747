"""Small tables with every awkward case: nulls, empty and long texts, ties, repeated rows, clashing column names."""

from __future__ import annotations

import random
import re

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}
SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, id string, key string, row string, node long, "
    "size string, rank string, part int, digest string, run int, score string, __id string, target int"
)


def words(text):
    return WORDS.findall((text or "").translate(LOWER))


def shingles(text):
    w = words(text)
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice(("ta", "ri", "mo", "ke", "lu", "san")) for _ in range(rng.randint(1, 4))) for _ in range(n))


def table(spark, pairs, sources=None):
    """documents with further columns of clashing names; ``pairs`` are (doc_id, text)."""
    rows = [
        (i, t, None, (sources or {}).get(k, "s"), None, "x", None, "y", 1, "z", "r", 0, None, 3, "q", "w", 9)
        for k, (i, t) in enumerate(pairs)
    ]
    return spark.createDataFrame(rows, SCHEMA)


def awkward(spark):
    long = prose(1, 60_000)
    return [
        (1, "one two three four five six"), (1, "one two three four five six"), (2, None), (3, ""), (4, " \t\n"), (None, "null id text"),
        (None, None), (5, long), (6, long + " tail"), (7, "One, two\nTHREE four five six"), (8, "é ü ñ 日本 語"), (9, "!!! ???"), (1, "same id, another text"),
    ]
