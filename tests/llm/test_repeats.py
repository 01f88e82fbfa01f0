"""Removal of repeats against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from symsearch.llm import queries, repeats
from symsearch.llm.run_length_index import RunLengthIndex, suffix_array
from tests.llm.fixtures import empty, odd


def plain(rows, length):
    """rows: texts as bytes -> (n_removed, n_spans, sha) of each."""
    starts = Counter(t[i : i + length] for t in rows for i in range(len(t) - length + 1))
    out = []
    for t in rows:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if starts[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(t, gone, strict=True) if not g)).hexdigest()))
    return out


def check(spark, rows, **how):
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in repeats.remove_repeats(docs, **how).collect()}
    want = plain([(t or "").encode() for t in rows], how.get("length", repeats.LENGTH))
    assert [(got[i].n_removed, got[i].n_spans, got[i].kept_sha256) for i in range(len(rows))] == want
    assert all(got[i].n_bytes == len((t or "").encode()) for i, t in enumerate(rows))
    return sum(w[0] for w in want)


def varied(seed, n=60, alphabet="abcdeé \n"):
    """Texts that share passages of about the window's length, with and without edits at their ends."""
    rng = random.Random(seed)
    word = lambda k: "".join(rng.choice(alphabet) for _ in range(k))
    passages = [word(rng.choice([380, 399, 400, 401, 415, 463, 500, 900])) for _ in range(8)]
    rows = []
    for _ in range(n):
        text = ""
        for _ in range(rng.randrange(4)):
            p = rng.choice(passages)
            a, b = rng.randrange(3) * rng.randrange(40), rng.randrange(3) * rng.randrange(40)
            text += word(rng.choice([0, 1, 50])) + p[a : len(p) - b] + word(rng.choice([0, 1, 50]))
        rows.append(text)
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(spark, seed):
    rows = varied(seed)
    assert check(spark, [*rows, rows[1], None, "", "x" * 399, "y" * 400, "z" * 401, "ab" * 900]) > 1000


def test_crowded_cores_are_split(spark, monkeypatch):
    """As far as it goes, and a little."""
    for most in (1, 3):
        monkeypatch.setattr(repeats, "CORE_MOST", most)
        assert check(spark, varied(7)) > 1000


@pytest.mark.parametrize("words", [False, True])
def test_indexes_and_halves(words):
    """Windows of contexts, by an index of all and by indexes of their halves, against counts."""
    rng = random.Random(5)
    kind, unit = (np.uint64, 8) if words else (np.uint8, 1)
    rows = {}
    for c in range(3):
        for _ in range(20):
            line = rng.choices([7, 1 << 40, 9] if words else b"ab", k=80)
            core, span = 30 + rng.randrange(4), 16
            first = core - rng.randrange(span)
            last = first + rng.randrange(core - first + 1)
            # windows of 16 symbols, the core among them, that begin from first to last
            head, tail = np.array(line[first:core], kind), np.array(line[core + 1 : last + span], kind)
            rows[c, head.tobytes(), tail.tobytes()] = (c, rng.random() < 0.2, span, words, rng.randrange(6), head.tobytes(), tail.tobytes(), c, len(rows), 0)
    rows = [r for r in rows.values()]
    rows.sort(key=lambda r: r[0])

    def windows(r):
        head, tail = (np.frombuffer(x, kind).tolist() for x in r[5:7])
        w = [*head, None, *tail]
        return [(r[0], tuple(w[i : i + r[2]])) for i in range(len(w) - r[2] + 1)]

    # bytes: anything else; words: anything of another row
    who = defaultdict(list)
    for r in rows:
        for w in windows(r):
            who[w] += [r[4] if words else len(who[w]), *([-1] if r[1] else [])]
    want = {(r[8], i) for r in rows for i, w in enumerate(windows(r)) if len(set(who[w])) > 1}
    covered = lambda found: {(x["context"], i) for x in found for i in range(x["a"], x["b"] + 1)}
    listed = lambda batches: [x for b in batches for x in b.to_pylist()]
    assert covered(listed(repeats._indexed(iter([repeats._pieces(rows)])))) == want
    halves = listed(repeats._halves(iter([repeats._pieces(rows)])))
    assert all(len(h["head"]) + len(h["tail"]) == (h["n"] + h["span"] - 2) * unit for h in halves)
    names = list(repeats._PIECE_NAMES)
    split = sorted((tuple(h[k] for k in names) for h in halves), key=lambda r: r[0])
    assert covered(listed(repeats._indexed(iter([repeats._pieces(split)])))) == want


def test_seen_twice():
    rng = np.random.default_rng(2)
    for slots in (1, 64, 1 << 12):
        seen, times = repeats.Seen(slots), Counter()
        for _ in range(30):
            some = rng.integers(0, 300, 200).astype(np.uint64)
            for x, twice in zip(some.tolist(), seen.twice(some).tolist(), strict=True):
                # never said too early; with room for all, always said
                assert not twice or times[x] >= 2
                assert slots < 4096 or twice == (times[x] >= 2)
                times[x] += 1


def test_copies_in_one_task(spark):
    """What a task has met twice isn't sent again."""
    rng = random.Random(3)
    passage = "".join(rng.choice("abc de") for _ in range(900))
    rows = ["".join(rng.choice("fgh ij") for _ in range(rng.randrange(60))) + passage[: rng.choice([900, 900, 640])] + str(i) for i in range(120)]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").coalesce(1)
    got = {r.doc_id: (r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.remove_repeats(docs).collect()}
    assert list(map(got.get, range(len(rows)))) == plain([r.encode() for r in rows], 400)


def plain_passages(rows, most):
    """Whether each row has ``most`` words in a row that another one has too."""
    words = [re.findall(rb"[^\x20\x09-\x0D]+", t) for t in rows]
    windows = [{tuple(w[i : i + most]) for i in range(len(w) - most + 1)} for w in words]
    times = Counter(x for w in windows for x in w)
    return [any(times[x] > 1 for x in w) for w in windows]


@pytest.mark.parametrize("most", [1, 1 << 20])
def test_passages_of_words(spark, monkeypatch, most):
    monkeypatch.setattr(repeats, "CORE_MOST", most)
    rng = random.Random(11)
    word = lambda: rng.choice("a bb ccc dé e ff gg 東 h iii".split()) + rng.choice("xyz")
    passages = [[word() for _ in range(rng.choice([48, 49, 50, 51, 60, 90]))] for _ in range(8)]
    rows = []
    for _ in range(50):
        text = []
        for _ in range(rng.randrange(4)):
            p = rng.choice(passages)
            text += [word() for _ in range(rng.randrange(30))] + p[rng.randrange(3) : len(p) - rng.randrange(3)]
        rows.append("".join(w + rng.choice([" ", "\n", "  ", "\t"]) for w in text))
    rows += [rows[5], None, "", "x " * 60, " y" * 50, " ".join(passages[0] * 3), "y\t" * 70]
    rows += [" ".join(x := [word() for _ in range(70)]) + " and again " + " ".join(x) for _ in range(5)]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.has_passage for r in repeats.remove_repeats(docs).collect()}
    want = plain_passages([(t or "").encode() for t in rows], 50)
    assert list(map(got.get, range(len(rows)))) == want
    assert sum(want) > 10 and want.count(False) > 10


def test_run_length_index_against_brute_force():
    rng = random.Random(1)
    for _ in range(150):
        text = np.array([rng.randrange(1, rng.choice([2, 3, 20]) + 1) for _ in range(rng.randrange(1, 60))] + [50_000])
        suffixes = [list(text[i:]) for i in range(len(text))]
        assert suffix_array(text.astype(np.uint64)).tolist() == sorted(range(len(text)), key=suffixes.__getitem__)
        common = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))  # noqa: B905, E731
        index = RunLengthIndex.build(text)
        assert index.lengths.sum() == len(text)
        assert index.longest_elsewhere().tolist() == [max((common(suffixes[i], suffixes[j]) for j in range(len(text)) if j != i), default=0) for i in range(len(text))]
        line = text.tolist()
        for _ in range(5):
            a = rng.randrange(len(line))
            asked = rng.choice([line[a : a + rng.randrange(1, 6)], [rng.randrange(4) for _ in range(2)]])
            assert index.occurrences(asked) == sum(line[i : i + len(asked)] == asked for i in range(len(line)))
    assert len(RunLengthIndex.build(np.array([7, 8, 9] * 400 + [60_000])).heads) < 12
    assert RunLengthIndex.build(np.zeros(0)).longest_elsewhere().tolist() == []


def test_short_windows(spark):
    rng = random.Random(9)
    rows = ["".join(rng.choice("ab") for _ in range(rng.randrange(200))) for _ in range(80)]
    assert check(spark, rows, length=20, span=8, passage=None) > 100


def test_long_texts_are_read_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(repeats, "BLOCK", 1 << 20)
    rng = random.Random(4)
    part = "".join(rng.choice("abcdefgh ") for _ in range(3000))
    long = "".join(rng.choice("abcdefgh ") for _ in range(2_400_000))
    at = (1 << 20) - 700
    rows = [long[:at] + part + long[at:], "q" + part[100:2000] + "r", long[2_000_000:2_001_000]]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r.doc_id: [tuple(x) for x in r.runs] for r in repeats.remove_repeats(docs).collect()}
    assert got == {0: [(at + 100, at + 2000), (2_003_000, 2_004_000)], 1: [(1, 1901)], 2: [(0, 1000)]}


def test_query_against_brute_force(spark, sf_dir):
    docs = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    found = queries.op5_suffix_dedup(spark, sf_dir).collect()
    got = {r.doc_id: (r.n_removed, r.n_spans, r.kept_sha256) for r in found}
    assert got == dict(zip(docs, plain(list(docs.values()), 400), strict=True))
    passages = dict(zip(docs, plain_passages(list(docs.values()), 50), strict=True))
    assert {r.doc_id: r.has_passage for r in found} == passages


def test_odd_rows(spark):
    docs = odd(spark)
    got = repeats.remove_repeats(docs).collect()
    rows = docs.collect()
    want = Counter((n, r.doc_id) for r, (n, _, _) in zip(rows, plain([(r.text or "").encode() for r in rows], 400), strict=True))
    assert Counter((r.n_removed, r.doc_id) for r in got) == want
    assert repeats.remove_repeats(empty(spark)).count() == 0
