"""Decontamination, SimHash, packing and host rules against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from symsearch.llm import decontamination, host_rules, packing, queries, simhash
from tests.llm.fixtures import SCHEMA, empty, odd, odd_rows, prose

WORD1 = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def plain_hits(text, items, window=13):
    words = WORD1.findall((text or "").translate(LOWER))
    hit, found = set(), set()
    for item, t in items:
        own = WORD1.findall((t or "").translate(LOWER))
        size = min(window, len(own))
        for i in range(len(own) - size + 1 if own else 0):
            for j in range(len(words) - size + 1):
                if words[j : j + size] == own[i : i + size]:
                    hit.update(range(j, j + size))
                    found.add(str(item))
    return len(words), len(hit), sorted(found)


@pytest.mark.parametrize("block_bytes", [1 << 24, 300])
def test_contamination_against_brute_force(spark, block_bytes):
    rng = random.Random(3)
    items = [(i, prose(rng, rng.choice([3, 14, 40]))) for i in range(15)] + [(99, None), (98, "..."), (97, "omega kappa alpha x1")]
    items += [(50, items[0][1])]
    rows = odd_rows()[:-4]
    planted = [(1000 + i, f"{prose(rng, 30)} {items[i % 15][1][: rng.choice([40, 400])]} {prose(rng, 30)}") for i in range(30)]
    docs = spark.createDataFrame([(r[0], r[1]) for r in rows if len(r[1] or "") < 5000] + planted, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: r for r in decontamination.find_contamination(docs, bench, block_bytes=block_bytes).collect()}
    some = 0
    for r in docs.collect():
        n, hit, names = plain_hits(r.text, items)
        g = got[r.doc_id]
        assert (g.n_words, g.n_hit, g["items"]) == (n, hit, names)
        assert g.items_sha256 == hashlib.sha256(",".join(names).encode()).hexdigest()
        assert g.contaminated == (hit > 0 and 20 * hit >= n)
        assert sum(s.length for s in g.spans) == hit
        some += hit > 0
    assert some > 10
    kept = {r.doc_id for r in decontamination.decontaminate(docs, bench, block_bytes=block_bytes).collect()}
    assert kept == {k for k, g in got.items() if not g.contaminated}


def test_longest_match_is_verbatim(spark):
    words = [f"w{i}" for i in range(60)]
    bench = spark.createDataFrame([("a", " ".join(words[:40])), ("b", " ".join(words[20:60]))], "item_id string, text string")
    docs = spark.createDataFrame([(1, " ".join(["x", *words[5:33], "y"])), (2, " ".join(words))], "doc_id long, text string")
    got = {r.doc_id: r for r in decontamination.find_contamination(docs, bench).collect()}
    assert got[1].longest_match == 28 and [tuple(s) for s in got[1].spans] == [(1, 28)]
    assert got[2].longest_match == 40 and got[2].n_hit == 60


def test_decontamination_of_odd_rows(spark):
    bench = spark.createDataFrame([(1, "word " * 20), (None, "z"), (2, None)], "item_id long, text string")
    docs = odd(spark)
    assert decontamination.find_contamination(docs, bench).count() == docs.count()
    kept = decontamination.decontaminate(docs, bench)
    assert kept.columns == docs.columns and kept.where("text is null").count() == docs.where("text is null").count()
    assert decontamination.find_contamination(empty(spark), bench).count() == 0
    assert decontamination.decontaminate(empty(spark), bench).count() == 0
    assert decontamination.find_contamination(docs, bench.limit(0)).where("contaminated").count() == 0


def plain_print(text):
    words = WORD.findall((text or "").translate(LOWER))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    ones = Counter(b for s in shingles for b in range(64) if xxhash.xxh64_intdigest(s, 42) >> b & 1)
    return sum(1 << b for b, n in ones.items() if 2 * n > len(shingles))


def plain_components(prints):
    """prints: id -> fingerprint."""
    parent = {k: k for k in prints}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    keys = sorted(prints)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {k: root(k) for k in keys}


def test_simhash_against_brute_force(spark, sf_dir):
    rows = queries.op7_simhash(spark, sf_dir).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    prints = {k: plain_print(t) for k, t in docs.items()}
    assert {r.doc_id: r.fingerprint for r in rows} == {k: f"{v:016x}" for k, v in prints.items()}
    assert {r.doc_id: r.component_id for r in rows} == plain_components(prints)


@pytest.mark.parametrize("bucket", [2, 5, 48])
def test_covering_finds_every_link_in_dense_balls(spark, bucket):
    rng = random.Random(7)
    centres = [rng.getrandbits(64) for _ in range(4)]
    prints = list({c ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) * rng.randrange(2) for c in centres for _ in range(70)})
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(p,) for p in signed], "f long")
    got = {(r.a, r.b) for r in simhash.links(df, bucket=max(bucket, 32) if bucket > 32 else 33 if bucket == 5 else 32).collect()}
    want = {tuple(sorted((a, b))) for i, a in enumerate(signed) for b in signed[i + 1 :] if ((a ^ b) & (1 << 64) - 1).bit_count() <= 2}
    assert got == want


def test_masks_cover_all_pairs_of_bits():
    for bits in (range(64), range(0, 27), range(3, 15), range(6)):
        masks = simhash.covering_masks([*bits])
        assert all(any(not m >> i & 1 and not m >> j & 1 for m in masks) for i in bits for j in bits)


def test_simhash_of_odd_rows(spark):
    docs = odd(spark)
    near = simhash.near_duplicates(docs).collect()
    assert len(near) == docs.count()
    by = defaultdict(set)
    for r in near:
        by[r.doc_id].add(r.component_id)
    assert by[43] == by[44] == by[45] == {min(43, *by[43])}  # null, empty, blank
    assert all(r.fingerprint == "0" * 16 for r in near if r.doc_id in (43, 44, 45))
    kept = simhash.deduplicate(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted({c for r in near if r.doc_id is not None for c in [r.component_id]})
    assert ids.count(None) == 2
    assert simhash.near_duplicates(empty(spark)).count() == 0 and simhash.deduplicate(empty(spark)).count() == 0


def test_packing_round_trip(spark, sf_dir):
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(queries.word_bpe())
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").repartition(5)
    want = {r.doc_id: np.array([*coder.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4").tobytes() for r in docs.collect()}
    whole = packing.pack(docs, queries.word_bpe()).collect()
    by, seq = defaultdict(list), defaultdict(list)
    for r in whole:
        by[r.doc_id].append(r)
        seq[r.sequence_id].append(r)
    assert set(by) == set(want)
    for k, pieces in by.items():
        pieces.sort(key=lambda r: r.start)
        assert b"".join(bytes(r.ids) for r in pieces) == want[k] and all(r.doc_tokens == len(want[k]) // 4 and len(r.ids) == 4 * r.length for r in pieces)
    for k, pieces in seq.items():
        pieces.sort(key=lambda r: r.offset)
        assert [r.offset for r in pieces] == [sum(p.length for p in pieces[:i]) for i in range(len(pieces))]
        assert sum(p.length for p in pieces) == 4096 or k == max(seq)
    assert sorted(seq) == [*range(len(seq))]
    made = packing.sequences(packing.pack(docs, queries.word_bpe())).collect()
    assert all(len(r.ids) == 4 * 4096 for r in made if r.n_tokens.bit_count() > 1) and len(made) == len(seq)


def test_packing_of_odd_rows(spark):
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(queries.word_bpe())
    docs = odd(spark)
    got = packing.pack(docs, queries.word_bpe(), length=64).collect()
    assert sum(r.length for r in got) == sum(len(coder.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in docs.collect())
    assert packing.pack(empty(spark), queries.word_bpe()).count() == 0
    digest = {r.doc_id: r for r in packing.pack(docs.where("doc_id = 43"), queries.word_bpe()).collect()}[43]
    assert (digest.length, zlib.crc32(bytes(digest.ids))) == (1, zlib.crc32(b"\x02\0\0\0"))


def plain_measures(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    inside = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside)


def test_measures_against_brute_force(spark):
    docs = odd(spark)
    rows = docs.collect()
    got = sorted((tuple(r)[:1] + tuple(r)[2:7] for r in host_rules.judge(docs).collect()), key=str)
    want = sorted(((r.doc_id, *plain_measures(r.text)) for r in rows), key=str)
    assert got == want


def test_host_verdicts(spark):
    good, junk = "plain words that say something new here " + " ".join(f"w{i}" for i in range(60)), " ".join(f"x{i} ###" for i in range(60))
    rows = [(i, good, None, "good", 1) for i in range(300)] + [(1000 + i, junk if i % 10 else good, None, "bad", 1) for i in range(100)]
    rows += [(2000 + i, good if i else junk, None, "few", 1) for i in range(6)] + [(3000, good, None, None, 1), (3001, junk, None, None, 1), (4000, junk, None, "good", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    judged = {r.doc_id: r for r in host_rules.judge(docs).collect()}
    assert {r.verdict for r in judged.values() if r.source == "bad"} == {"bad"} and not judged[1000].kept
    assert judged[0].verdict == "trusted" and judged[4000].kept
    assert judged[2001].kept and judged[3000].kept and not judged[3001].kept
    kept = host_rules.keep_good(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {k for k, r in judged.items() if r.kept}


def test_host_rules_of_odd_rows(spark):
    docs = odd(spark)
    judged = host_rules.judge(docs)
    assert host_rules.keep_good(docs).count() == judged.where("kept").count()
    assert judged.where("kept and (n_words = 0)").count() == 0
    assert host_rules.judge(empty(spark)).count() == 0 and host_rules.keep_good(empty(spark)).count() == 0
    assert len(SCHEMA.split(",")) == len(host_rules.keep_good(docs).columns)
