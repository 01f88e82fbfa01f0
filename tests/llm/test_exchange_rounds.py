"""Exchange goes on until no unit moves, however many rounds that takes."""

import numpy as np

from symsearch.llm import class_lm
from tests.llm.test_class_lm import plain_likelihood


def test_exchange_has_no_last_round():
    many = 0
    for seed in range(2):
        pairs = np.random.default_rng(seed).poisson(0.3, (500, 500))
        of = class_lm.exchange(pairs, classes=12)
        assert (of == class_lm.exchange(pairs, classes=12, rounds=1000)).all()
        many += not (of == class_lm.exchange(pairs, classes=12, rounds=12)).all()
    assert many


def test_no_round_lowers_the_likelihood():
    for seed in range(8):
        pairs = np.random.default_rng(seed).poisson(0.3, (60, 60))
        steps = [plain_likelihood(pairs, class_lm.exchange(pairs, classes=12, rounds=r)) for r in range(12)]
        assert all(b >= a - 1e-6 for a, b in zip(steps, steps[1:], strict=False))
