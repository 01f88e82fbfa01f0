"""The class model against brute force, and its perplexity on held-out texts."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from symsearch.llm import class_lm, queries
from tests.llm.fixtures import empty, odd

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
END = object()


def plain_tokens(text):
    return [*WORD.findall((text or "").translate(LOWER)), END]


def plain_base(rows, training):
    counts = Counter(t for k, text in rows if training(k) for t in plain_tokens(text))
    n, v = sum(counts.values()), len(counts)
    out = {}
    for k, text in rows:
        own = plain_tokens(text)
        out[k] = (len(own), sum(counts[t] > 0 for t in own), n, sum(math.log10((counts[t] + 0.5) / (n + 0.5 * (v + 1))) for t in own))
    return out


def classes_of(model):
    """The class of any word, and of the end."""
    rest = {bytes(r.word): r["class"] for r in model.rest.collect()}
    numbers = model.head.numbers
    return lambda t: 0 if t is END else int(model.classes[numbers[t]]) if t in numbers else rest.get(t, int(model.classes[-1 - class_lm.ending(t)]))


@pytest.mark.parametrize("head", [class_lm.HEAD, 50, 0])
def test_base_and_model_against_brute_force(spark, sf_dir, head):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    training = lambda k: zlib.crc32(str(k).encode()) % 5 != 1
    model = class_lm.fit(docs, training=class_lm.in_training("doc_id"), head=head)
    got = {r.doc_id: r for r in class_lm.score(model).collect()}
    assert {r.doc_id: tuple(r) for r in class_lm.score(model, docs.repartition(3)).collect()} == {k: pytest.approx(tuple(r), rel=1e-9) for k, r in got.items()}
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = plain_base(rows, training)
    for k, (n, known, total, base) in want.items():
        r = got[k]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total)
        assert r.base_score == pytest.approx(base, rel=1e-9)
    # the model's own probabilities, from its classes
    of = classes_of(model)
    encoded = lambda text: [t if t is END else t.encode() for t in plain_tokens(text)]
    texts = [encoded(text) for k, text in rows if training(k)]
    counts = Counter(t for text in texts for t in text)
    in_class, kinds, pairs = Counter(), Counter(), Counter()
    for t, n in counts.items():
        in_class[of(t)] += n
        kinds[of(t)] += 1
    for text in texts:
        line = [0, *map(of, text)]
        pairs.update(zip(line, line[1:]))  # noqa: B905
    assert {c: n for c, n in enumerate(model.in_class) if n} == dict(in_class)
    after = {}
    for c in range(class_lm.CLASSES):
        row = {d: pairs[c, d] for d in range(class_lm.CLASSES)}
        weight = sum(n > 0 for n in row.values()) or 1
        prior = lambda d: (in_class[d] + 0.5) / (sum(in_class.values()) + 0.5 * class_lm.CLASSES)
        after[c] = [(n + weight * prior(d)) / (sum(row.values()) + weight) for d, n in row.items()]
        assert sum(after[c]) == pytest.approx(1)
    for k, text in rows[:40]:
        before, total = 0, 0.0
        for t in encoded(text):
            c = of(t)
            total += math.log10(after[before][c])
            if t is not END:
                total += math.log10((counts[t] + 0.5) / (in_class[c] + 0.5 * (kinds[c] + 1)))
            before = c
        assert got[k].score == pytest.approx(total, rel=1e-9)


def plain_best(pairs, of, u, classes):
    """The class of the likeliest of all tables that differ in one word."""
    best, least = of[u], plain_likelihood(pairs, of) + 1e-6
    for c in range(1, classes):
        other = of.copy()
        other[u] = c
        if (now := plain_likelihood(pairs, other)) > least:
            best, least = c, now
    return best


def test_moves_against_whole_likelihoods():
    rng = np.random.default_rng(3)
    for _ in range(3):
        pairs = rng.poisson(0.6, (25, 25))
        of = np.concatenate(([0], rng.integers(1, 5, 24)))
        onehot = np.eye(5, dtype=np.int64)[of]
        m = onehot.T @ pairs @ onehot
        alone = pairs - np.diag(np.diag(pairs))
        new = class_lm.best_classes((onehot.T @ alone).T[1:], (alone @ onehot)[1:], np.diag(pairs)[1:], of[1:], m)
        assert new.tolist() == [plain_best(pairs, of, u, 5) for u in range(1, 25)]
        assert class_lm.likelihood(m) == pytest.approx(plain_likelihood(pairs, of))


def test_rounds_against_plain_exchange(spark, monkeypatch):
    """The whole clustering: units, rounds over halves of the head, then the other words."""
    monkeypatch.setattr(class_lm, "WORD_UNITS", 6)
    rng = random.Random(8)
    vocabulary = [a + b for a in ("ka", "lo", "mi", "nu", "x") for b in ("", "sa", "te", "ri")]
    texts = [" ".join(rng.choice(vocabulary[: rng.choice([5, 12, 20])]) for _ in range(rng.randrange(25))) for _ in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    model = class_lm.fit(docs, classes=5, head=12)
    words = [None, *sorted({w for t in texts for w in t.encode().split()}, key=lambda w: (-sum(t.encode().split().count(w) for t in texts), w))]
    at = {w: i for i, w in enumerate(words)}
    pairs = np.zeros((len(words),) * 2, np.int64)
    for t in texts:
        line = [0, *(at[w] for w in t.encode().split()), 0]
        for a, b in zip(line, line[1:]):  # noqa: B905
            pairs[a, b] += 1
    head = len(model.head.numbers)
    assert 6 < head <= 12 < len(words) and list(model.head.numbers) == words[1 : head + 1]
    unit = np.array([0] + [i if i <= 6 else 7 + class_lm.ending(w) for i, w in enumerate(words)][1:])
    of_units = np.zeros((7 + class_lm.ENDINGS,) * 2, np.int64)
    np.add.at(of_units, (unit[:, None] + 0 * unit, unit + 0 * unit[:, None]), pairs)
    of = class_lm.exchange(of_units, 5)[unit]
    steps = [plain_likelihood(pairs, of)]
    for r in range(class_lm.ROUNDS):
        new = of.copy()
        for u in range(1, head + 1):
            if zlib.crc32(words[u]) & 1 == r % 2:
                new[u] = plain_best(pairs, of, u, 5)
        if plain_likelihood(pairs, new) <= steps[-1]:
            break
        of = new
        steps.append(plain_likelihood(pairs, of))
    final = of.copy()
    for u in range(head + 1, len(words)):
        if pairs[u].sum() >= class_lm.LEAST:
            final[u] = plain_best(pairs, of, u, 5)
    assert model.likelihoods == pytest.approx(steps) and len(steps) > 1
    assert [classes_of(model)(w) for w in words[1:]] == final[1:].tolist()
    assert {bytes(r.word): r.n for r in model.rest.collect()} == {w: pairs[at[w]].sum() for w in words[head + 1 :]}


def test_model_beats_base_on_held_out_texts(spark):
    rows = queries.op4_class_lm(spark, "/root/testdata/sf0.01").where("held_out").collect()
    tokens = sum(r.n_tokens for r in rows)
    base, score = (-sum(getattr(r, x) for r in rows) / tokens for x in ("base_score", "score"))
    assert score < base
    # far from what endings alone reach
    assert 10**score < 0.8 * 10**base


def plain_likelihood(pairs, of):
    m = np.zeros((max(of) + 1,) * 2)
    np.add.at(m, (of[:, None] + 0 * of[None], of[None] + 0 * of[:, None]), pairs)
    f = lambda x: float((x * np.log(np.maximum(x, 1e-300))).sum())
    return f(m) - f(m.sum(0)) - f(m.sum(1))


def test_exchange_ends_where_no_move_helps():
    rng = np.random.default_rng(5)
    pairs = rng.poisson(0.7, (30, 30)) + 5 * (rng.integers(0, 3, 30)[:, None] == (rng.integers(0, 3, 30)[None] + 1) % 3)
    of = class_lm.exchange(pairs, classes=5, rounds=50)
    best = plain_likelihood(pairs, of)
    assert of[0] == 0 and (of[1:] > 0).all()
    for u in range(1, 30):
        for c in range(1, 5):
            other = of.copy()
            other[u] = c
            assert plain_likelihood(pairs, other) <= best + 1e-6


def test_classes_of_a_plain_grammar(spark):
    rng = random.Random(2)
    kinds = [["red", "green", "blue", "pale"], ["cat", "dog", "cow", "fox"], ["runs", "eats", "sits", "hides"]]
    docs = spark.createDataFrame([(i, " ".join(rng.choice(kinds[j % 3]) for j in range(30))) for i in range(100)], "doc_id long, text string")
    model = class_lm.fit(docs, classes=4)
    of = {w.decode(): int(model.classes[i]) for w, i in model.head.numbers.items()}
    assert [len({of[w] for w in k}) for k in kinds] == [1, 1, 1] and len(set(of.values())) == 3


def test_odd_rows(spark):
    docs = odd(spark)
    scored = class_lm.score(class_lm.fit(docs)).collect()
    assert len(scored) == docs.count() and all(r.score < 0 and math.isfinite(r.score) for r in scored)
    assert {r.n_tokens for r in scored if r.doc_id in (43, 44, 45)} == {1}
    assert class_lm.score(class_lm.fit(docs), empty(spark)).count() == class_lm.score(class_lm.fit(empty(spark))).count() == 0
    nothing = class_lm.score(class_lm.fit(empty(spark)), docs).collect()
    assert len(nothing) == docs.count() and all(math.isfinite(r.score) and r.train_tokens == 0 and r.n_known == 0 and r.base_score == 0 for r in nothing)
