"""Small tables for the text operators' tests."""

from __future__ import annotations

import random
import re
import string
from pathlib import Path

DATA = Path("/root/testdata")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, key string, row string, node int, line int, size string, part int, n_words string, toxicity_ string"

LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000))
AWKWARD = [
    (None, "a null id with enough words to be a line of its own here"),
    (1, None),
    (2, ""),
    (3, " \t\n\x0b\x0c\r "),
    (4, "one"),
    (5, LONG),
    (6, "Same row twice, word for word, in every column."),
    (6, "Same row twice, word for word, in every column."),
    (7, "Same row twice, word for word, in every column."),
    (8, "Über été İΣ  wide space \U0001f600!? it's   <b>bold</b>...\n\nnext line"),
    (9, "a\x1cb\x85c 12,345.67 -- don't we'll I'M"),
    (None, None),
]


def table(spark, rows):
    """``rows`` are (doc_id, text); the other columns have names that operators might use."""
    full = [(i, t, "en" if (i or 0) % 3 else None, "web" if (i or 0) % 2 else None, len(t or ""), "k", "r", 1, 2, "s", 3, "n", "t") for i, t in rows]
    return spark.createDataFrame(full, SCHEMA)


def words_of(n, rng, vocabulary=2000):
    return [f"{rng.choice(string.ascii_lowercase)}{rng.randrange(vocabulary)}" for _ in range(n)]


def near_copies(seed, groups=6, size=5, words=80):
    """Documents in groups: a text and versions with some words replaced, some of them just over the bound, some under."""
    rng, rows = random.Random(seed), []
    for _ in range(groups):
        base = words_of(words, rng)
        for k in range(size):
            text = list(base)
            for _ in range(rng.randrange(4)):
                text[rng.randrange(words)] = f"new{rng.randrange(10**6)}"
            rows.append((len(rows) + 10, " ".join(text[: words - 2 * k])))
    rng.shuffle(rows)
    return rows


def shingles(text, size=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def components(nodes, linked):
    """Smallest reachable index of each."""
    parent = list(range(len(nodes)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(nodes)):
        for j in range(i):
            if linked(nodes[i], nodes[j]):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return [find(i) for i in range(len(nodes))]
