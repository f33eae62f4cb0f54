"""Rows with everything that operators must bear."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
# Columns whose names the operators use inside.
EXTRA = {"kept": "x", "score": "y", "bucket": "z", "key": "k", "sig": "s", "part": "p", "place": "q", "__norm": "n", "copies": "c", "rid": "r"}


def invented(rng, n, words=("the", "of", "river", "Stone", "light,", "and", "wind.", "a", "grey", "cloud", "with", "song", "to", "old", "house")):
    return " ".join(rng.choice(words) for _ in range(n))


def messy_rows():
    """Nulls in every column, empty and very long texts, ties, repeated rows, copies and near copies."""
    rng = random.Random(3)
    base = " ".join(f"w{rng.randrange(10_000)}" for _ in range(120))
    rows = [
        (1, None, "en", "a", 0),
        (2, "", None, "a", 0),
        (3, base, "en", None, 1),
        (4, base.upper(), "en", "a", None),
        (5, base + " tail", "de", "b", 3),
        (5, base + " tail", "de", "b", 3),
        (None, base, "en", "b", 2),
        (None, None, None, None, None),
        (6, "short", "en", "b", 5),
        (7, "two words", "fr", "b", 5),
        (8, "ÄÖ ß É 日本 😀 K", "de", "c", 5),
        (9, invented(rng, 30_000), "en", "c", 1),
        (10, "x" * 3000, "en", "c", 1),
        (11, "ab" * 2000 + " " + base, "en", "c", 1),
        (12, " \t\n\x0b ", "en", "c", 1),
        (-4, "\x00 odd \x00 bytes ▁ here", "en", "c", 1),
    ]
    return rows + [(100 + i, invented(rng, rng.randrange(1, 200)), rng.choice(["en", "de"]), rng.choice("abc"), i) for i in range(40)]
