"""Small tables with every odd case."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words string, kept int, component_id string, f string, t string, n string, host string, soft string, verdict string, row string, clean string, doc string, slot string"

NONE = (None,) * 16

WORDS = "the of and alpha beta gamma delta Éclair naïve x1 y2 don't straße 東京 omega kappa".split()


def prose(rng: random.Random, n: int) -> str:
    return "".join(rng.choice(WORDS) + rng.choice([" ", " ", " ", "\n", "\t", ", "]) for _ in range(n))


def odd_rows(seed: int = 1) -> list[tuple]:
    """Nulls in each column, empty and long texts, ties, repeated rows, and columns with names that operators use."""
    rng = random.Random(seed)
    texts = [prose(rng, rng.choice([1, 2, 3, 12, 13, 60, 200])) for _ in range(40)]
    texts += [texts[3], texts[3], texts[5] + " end", None, "", " \n\t ", "x", "word " * 300, "a\x00b\x1c c d\u0085e", prose(rng, 20_000), "z" * 50_000]
    rows = [(i, t, "en", f"host{i % 3}", len(t or ""), "own", 7, "c", "f", "t", "n", *"hsvrcds") for i, t in enumerate(texts)]
    return [*rows, rows[0], rows[0], (None, texts[1], *NONE), (None, None, *NONE), (900, texts[7], *NONE)]


def odd(spark, seed: int = 1):
    return spark.createDataFrame(odd_rows(seed), SCHEMA).repartition(5)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
