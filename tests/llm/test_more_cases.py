"""Cases that the tables at hand don't have: bad and trusted hosts, long texts, several blocks, repeated ids, empty tables."""

import random

import pyarrow as pa
import pyarrow.parquet as pq

from symsearch.llm import decontamination, oracles, packing, queries, sharding, simhash
from symsearch.llm.components import components
from tests.llm.fixtures import empty
from tests.oracle import same


def test_host_rules_against_sql(spark, tmp_path):
    """Hosts of all verdicts."""
    rng = random.Random(4)
    good = lambda: " ".join(f"word{rng.randrange(10**6)}" for _ in range(60))
    junk = lambda: " ".join(f"x{rng.randrange(10**6)} ###" for _ in range(60))
    rows = [(h, junk() if rng.random() < rate else good()) for h, n, rate in (("good", 400, 0.0), ("bad", 120, 0.9), ("mixed", 200, 0.3), ("few", 5, 1.0), (None, 30, 0.5)) for _ in range(n)]
    rows += [("good", junk()), ("good", "short"), ("bad", None), ("mixed", "a b c " * 40)]
    table = pa.table({"doc_id": list(range(len(rows))), "text": [t for _, t in rows], "source": [h for h, _ in rows]})
    pq.write_table(table, f"{tmp_path}/documents.parquet")
    assert same(spark, str(tmp_path), queries.op10_host_rules, oracles.OP10) == len(rows)
    judged = {(r.source, r.verdict) for r in queries.host_rules.judge(spark.read.parquet(f"{tmp_path}/documents.parquet")).select("source", "verdict").collect()}
    assert {("good", "trusted"), ("bad", "bad"), ("mixed", "normal"), (None, "normal")} <= judged


def test_components_against_union_find(spark):
    rng = random.Random(6)
    for n, m in ((60, 40), (200, 150), (30, 200)):
        pairs = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] + [(0, i) for i in range(1000, 1000 + n)] + [(i, i + 1) for i in range(2000, 2060)]
        parent: dict[int, int] = {}

        def root(k, parent=parent):
            while parent.setdefault(k, k) != k:
                k = parent[k]
            return k

        for a, b in pairs:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
        got = {r.id: r.component for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
        alone = {k for k in parent if root(k) == k and sum(root(x) == k for x in parent) == 1}
        assert got == {k: root(k) for k in parent if k not in alone}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_long_texts_are_judged_whole(spark):
    rng = random.Random(7)
    long = " ".join(f"w{rng.randrange(10**7)}" for _ in range(600_000))
    item = " ".join(f"item{i}" for i in range(40))
    assert len(long) > 4 << 20
    docs = spark.createDataFrame([(1, f"{long} {item}"), (2, long), (3, f"{item} and more"), (4, item[:20])], "doc_id long, text string")
    bench = spark.createDataFrame([(9, item)], "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.contaminated) for r in decontamination.find_contamination(docs, bench).collect()}
    assert got[1] == (600_040, 40, False) and got[2] == (600_000, 0, False) and got[3] == (42, 40, True)
    assert sorted(r.doc_id for r in decontamination.decontaminate(docs, bench).collect()) == [1, 2, 4]


def test_one_block_at_a_time():
    class Shared:
        loaded: list = []

        def __init__(self, block):
            self._kept = block

        @property
        def value(self):
            if "_value" not in self.__dict__:
                Shared.loaded.append(self)
                self._value = self._kept
            assert sum("_value" in s.__dict__ for s in shared) == 1
            return self._value

    items = [(i, " ".join(f"i{i}w{j}" for j in range(20)).encode()) for i in range(3)]
    shared = [Shared(decontamination.BenchmarkBlock.build([x])) for x in items]
    texts = [items[0][1] + b" x " + items[2][1], b"nothing", items[1][1]]
    found = list(decontamination.match_texts(texts, shared))
    assert [(a, b) for a, b, *_ in found] == [(0, 3)]
    _, _, hits, names, longest = found[0]
    assert [int(h.sum()) for h in hits] == [40, 0, 20] and names == [{"0", "2"}, set(), {"1"}] and longest == [20, 0, 20]
    assert len(Shared.loaded) == 3


def test_one_row_of_a_repeated_id_stays(spark):
    texts = {1: ["b text of five words here", "a text of six words here now", None], 2: ["some other thing that is quite different " * 3], 3: ["zz yy xx ww vv uu tt"] * 3}
    rows = [(i, t, f"s{n}") for i, own in texts.items() for n, t in enumerate(own)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, r string").repartition(3)
    got = simhash.deduplicate(docs)
    assert got.columns == docs.columns
    # the first text in order: a null one, if there is one
    assert sorted((r.doc_id, r.text) for r in got.collect()) == [(1, None), (2, texts[2][0]), (3, texts[3][0])]


def test_sequences_of_nothing(spark):
    pieces = packing.pack(empty(spark), queries.word_bpe())
    assert packing.sequences(pieces).count() == 0
    no_texts = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert [(r.n_tokens, len(r.ids)) for r in packing.sequences(packing.pack(no_texts, queries.word_bpe())).collect()] == [(2, 8)]


def test_a_hot_key_is_written_by_several_tasks(spark, tmp_path):
    docs = spark.createDataFrame([(7, f"t{i}", "own", "s") for i in range(400)], "doc_id long, text string, slot string, shard string").repartition(4)
    sharding.write_shards(docs, str(tmp_path / "out"), parts=3)
    again = spark.read.parquet(str(tmp_path / "out"))
    assert again.count() == 400 and len(again.inputFiles()) > 1 and {r.slot for r in again.collect()} == {"own"} and again.select("shard").distinct().count() == 1
