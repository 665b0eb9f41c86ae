"""Small tables with nulls, empty and long texts, ties, repeated rows and clashing names."""

from __future__ import annotations

import random
import re

SPACE = re.compile(r"[\x20\x09-\x0D]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")

#: Extra columns named like columns that operators make.
SCHEMA = (
    "doc_id long, text string, kept boolean, row long, tokens array<int>, n int, component_id long,"
    " bucket int, shard int, words string, `Keep_Id` long, `a.b` int"
)
EXTRA = (None, 1, [1], 2, 3, 4, 5, "w", 6, 7)


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    words = [f"w{rng.randrange(40)}" if rng.random() < 0.5 else f"x{rng.randrange(4000)}é" for _ in range(n)]
    return " ".join(w + ("\n" if rng.random() < 0.08 else "") for w in words)


def edited(text: str, seed: int, edits: int) -> str:
    rng, words = random.Random(seed), text.split(" ")
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"edit{rng.randrange(10**6)}"
    return " ".join(words)


BASE = prose(1, 120)
LONG = prose(2, 30_000)
ROWS = [
    (1, None), (2, ""), (3, " \n\t"), (4, "one two"), (5, "ONE  two"), (6, "onetwo"),
    (7, BASE), (8, BASE), (9, BASE.replace(" ", "  ")), (9, BASE.replace(" ", "  ")),
    (10, edited(BASE, 3, 2)), (11, edited(BASE, 4, 5)), (12, edited(BASE, 5, 9)),
    (13, LONG), (14, LONG + " end"), (None, BASE), (None, "alone without an id"), (None, None),
    (15, prose(6, 80)), (16, prose(7, 80)), (17, "a b c d e"), (18, "A b c d e"),
    (19, "same line here with words\n" * 4 + "and another line of its own"),
    (20, "same line here with words\n▁x  ▁ y z\x1c՘ '' 's'stop  \n\n\nq"),
    (21, "日本語 テキスト　です 👩‍👩‍👧 ñ"), (4, "one two"),
    *[(100 + i, edited(BASE, 50 + i, i % 12)) for i in range(30)],
]


def messy(spark):
    return spark.createDataFrame([(*r, *EXTRA) for r in ROWS], SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def linked_components(pairs, ids):
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return {i: root(i) for i in ids}
