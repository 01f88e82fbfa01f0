"""The whole pipeline against a brute-force version of it."""

import re
from collections import defaultdict

import corpus_pipeline
from symsearch.llm import host_rules, queries, secret_scan
from tests.llm.fixtures import odd
from tests.llm.test_first_operators import plain_components, plain_hits, plain_measures, plain_print
from tests.llm.test_plain_models import PlainScan


def test_pipeline_against_brute_force(spark, sf_dir):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    # quality rules
    hosts, facts = defaultdict(lambda: [0, 0]), {}
    for r in docs:
        n, chars, symbols, dup, rep = plain_measures(r.text)
        lines = len([x for x in (r.text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)])
        hard = n < 50 or 100 * rep > 50 * n
        soft = 10 * symbols > n or 2 * dup > lines or chars < 2 * n or chars > 15 * n
        facts[r.doc_id] = hard, soft
        hosts[r.source][0] += 1
        hosts[r.source][1] += hard or soft
    total = sum(n for n, _ in hosts.values())
    mean = sum(f for _, f in hosts.values()) / total
    # what the hosts' rates vary beyond chance, by moments
    beyond = sum(f * f / n for n, f in hosts.values()) / total - mean**2 - (len(hosts) - 1) * mean * (1 - mean) / total
    strength = min(1e6, max(1.0, mean * (1 - mean) / beyond - 1)) if beyond > mean * (1 - mean) / 1e6 else 1e6
    a, b = mean * strength, (1 - mean) * strength
    rate = {h: (f + a) / (n + a + b) for h, (n, f) in hosts.items()}
    left = [r for r in docs if not facts[r.doc_id][0] and rate[r.source] < host_rules.BAD_RATE and (rate[r.source] < host_rules.TRUSTED_RATE or not facts[r.doc_id][1])]
    # near duplicates
    groups = plain_components({r.doc_id: plain_print(r.text) for r in left})
    left = [r for r in left if groups[r.doc_id] == r.doc_id]
    # decontamination
    left = [r for r in left if not (h := plain_hits(r.text, items))[1] or 20 * h[1] < h[0]]
    # secrets: the forest is the operator's own, what it is given and what becomes of the texts is not
    labelled = secret_scan.labelled_findings(spark)
    scanner = secret_scan.learn(spark.createDataFrame(left), labelled)
    plain = PlainScan([r.text for r in left], labelled, scanner.forest)
    texts = {r.doc_id: plain.redact(r.text, r.source) for r in left}
    coder = Tokenizer.from_file(queries.word_bpe())
    want = {k: len(coder.encode(t, add_special_tokens=False).ids) + 1 for k, t in texts.items()}
    got = defaultdict(int)
    for r in corpus_pipeline.run(spark, sf_dir).collect():
        got[r.doc_id] += r.length
        assert r.doc_tokens == want[r.doc_id]
    assert got == want and 0 < len(want) < len(docs)


def test_stages_keep_the_columns_of_odd_rows(spark, sf_dir):
    docs = odd(spark)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == odd(spark).columns
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).count() > 0


def test_stages_take_empty_tables(spark, sf_dir):
    nothing = odd(spark).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, sf_dir).count() == 0
