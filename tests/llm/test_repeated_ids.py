"""Rows of one id with unlike texts are one document."""

import random

from symsearch.llm import simhash


def test_all_texts_of_an_id_are_linked(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(7))
    a, b, c, d = (" ".join(word() for _ in range(80)) for _ in range(4))
    two = [(5, a), (5, b), (3, b), (9, a), (4, d)]
    three = [(20, a), (20, b), (20, c), (11, a), (12, b), (13, c), (14, d)]
    for rows, want in ((two, {5: 3, 3: 3, 9: 3, 4: 4}), (three, {20: 11, 11: 11, 12: 11, 13: 11, 14: 14})):
        got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert len(got) == len(rows) and {(r.doc_id, r.component_id) for r in got} == set(want.items())
