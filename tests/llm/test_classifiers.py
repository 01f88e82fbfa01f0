"""Toxicity, quality and secrets: held-out accuracy, brute force and odd rows."""

import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from symsearch.llm import pairwise_quality, queries, secret_scan, toxicity
from symsearch.llm.measures import MEASURES, measure
from tests.llm.fixtures import empty, odd

BIG = "/root/testdata/sf0.1"


def labels_of(spark, sf_dir, column):
    return {r.doc_id: r[column] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}


def area(scores, labels):
    order = np.argsort(np.argsort(scores)) + 1
    good = labels.sum()
    return (order[labels == 1].sum() - good * (good + 1) / 2) / (good * (len(labels) - good))


@pytest.fixture(scope="module")
def quality(spark):
    return {r.doc_id: r for r in queries.op6_pairwise_quality(spark, BIG).collect()}


def test_quality_on_held_out_labels(spark, quality):
    labels = {k: v for k, v in labels_of(spark, BIG, "quality").items() if quality[k].held_out}
    y = np.array([*labels.values()])
    assert all(quality[k].held_out == (zlib.crc32(str(k).encode()) % 5 == 0) for k in quality)
    assert area(np.array([quality[k].score for k in labels]), y) > 0.99
    assert np.mean([quality[k].predicted == v for k, v in labels.items()]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in quality.values())


def test_quality_never_sees_held_out_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    turned = labels.withColumn("quality", F.when(pairwise_quality.held_out("doc_id"), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = ({r.doc_id: r.score for r in pairwise_quality.score_quality(docs, x).collect()} for x in (labels, turned))
    assert a == b


def test_quality_columns_say_what_the_model_says():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 5))
    y = (x[:, 0] - x[:, 1] + 0.1 * rng.normal(size=400) > -0.5).astype(int)
    model = pairwise_quality.PairwiseModel.fit(x, y, pairs=5000)
    raw = np.clip((x - model.mean) / model.scale, -5, 5) @ model.weights
    assert area(raw, y) > 0.98
    assert np.mean((raw >= model.threshold) == y) > 0.93
    assert abs((raw < model.threshold).mean() - model.quantile) < 0.01


def test_quality_of_odd_rows(spark):
    docs = odd(spark)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)] + [(None, 1, 1), (3, None, None), (4, 0, 0)], "doc_id long, quality int, toxic int")
    got = pairwise_quality.score_quality(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and math.isfinite(r.score) for r in got)
    assert pairwise_quality.score_quality(empty(spark), labels).count() == 0
    same = pairwise_quality.score_quality(docs, labels.limit(0)).collect()
    assert all(abs(r.score - 0.3) < 1e-8 for r in same) and {r.predicted for r in same} == {1}


def test_measures_are_finite():
    for t in (b"", b" ", b"\n", b"x", b"a\x00b", "é".encode() * 1000, b"!!! ### |" * 50):
        assert len(measure(t)) == len(MEASURES) and all(map(math.isfinite, measure(t)))


def test_toxicity_on_held_out_labels(spark):
    got = {r.doc_id: r for r in queries.op2_toxicity(spark, BIG).collect()}
    labels = {k: v for k, v in labels_of(spark, BIG, "toxic").items() if got[k].held_out}
    y = np.array([*labels.values()])
    assert area(np.array([got[k].p_toxic for k in labels]), y) > 0.97
    found = np.array([got[k].toxic for k in labels])
    assert (found & (y == 1)).sum() / max(1, found.sum()) > 0.9 and found[y == 1].mean() > 0.85


def test_later_models_use_earlier_ones():
    rng = np.random.default_rng(2)
    n = 600
    form = rng.normal(size=(n, len(MEASURES)))
    first = (form[:, 0] > 0).astype(int)
    labels = np.stack([first, first], axis=1)
    chain = toxicity.Chain.fit(["a", "b"], [np.zeros(0, np.int64)] * n, form, labels, np.arange(n) % toxicity.FOLDS)
    assert len(chain.weights[1]) == len(chain.weights[0]) + 1
    assert chain.weights[1][-2] > abs(chain.weights[0]).min()


def test_toxicity_of_odd_rows(spark):
    docs = odd(spark)
    labels = spark.createDataFrame([(i, i % 2, int(i % 3 == 0)) for i in range(40)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    how = ({"low": F.col("quality") == 0, "toxic": F.col("toxic") == 1}, ["quality", "toxic"])
    chain = toxicity.fit_chain(docs, labels, *how)
    got = toxicity.score_toxicity(docs, chain).collect()
    assert len(got) == docs.count() and all(0 <= r.p_toxic <= 1 for r in got)
    assert toxicity.score_toxicity(empty(spark), chain).count() == 0
    nothing = toxicity.fit_chain(docs, labels.limit(0), *how)
    assert not any(r.is_toxic for r in toxicity.score_toxicity(docs, nothing).collect())


SECRETS = re.compile(r'AKIA[0-9A-Z]{16}|(?<=token = ")[0-9a-f]{40}|(?<=password=)[0-9a-f]{18}')


@pytest.fixture(scope="module")
def scanner(spark):
    return secret_scan.learn(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


def test_forest_on_other_labelled_findings(spark, scanner):
    other = secret_scan.labelled_findings(spark, 1500, seed=77)
    measured = other.selectExpr("label", "named_struct(" + ", ".join(f"'{k}', cast({v} as double)" for k, v in scanner.measures.items()) + ") as f")
    right = measured.selectExpr(f"avg(if(({scanner.forest} >= 0.5) = (label = 1), 1.0, 0.0)) as r").first().r
    assert float(right) > 0.93


def test_planted_secrets_are_found_and_numbers_are_not(spark, scanner):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = secret_scan.scan(docs, scanner=scanner).collect()
    found = {(r.doc_id, r.value) for r in rows if r.is_secret}
    want = {(r.doc_id, s) for r in docs.collect() for s in SECRETS.findall(r.text)}
    assert want and want <= found
    assert all(not r.is_secret for r in rows if re.fullmatch(r"[0-9]{16}", r.value))


def test_redaction_changes_secrets_alone(spark, scanner):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = {}
    for r in secret_scan.scan(docs, scanner=scanner).where("is_secret").collect():
        found.setdefault(r.doc_id, set()).add(r.value)
    got = {r.doc_id: r for r in secret_scan.redact(docs, scanner=scanner).collect()}
    for r in docs.collect():
        text = r.text
        for value in found.get(r.doc_id, ()):
            text = text.replace(value, "<SECRET>")
        assert got[r.doc_id].text == text
        assert got[r.doc_id].n_chars == (len(text) if text != r.text else r.n_chars)


def test_secret_scan_stays_in_the_jvm(spark, scanner):
    plan = secret_scan.redact(odd(spark), scanner=scanner)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_secret_scan_of_odd_rows(spark, scanner):
    docs = odd(spark)
    assert secret_scan.redact(docs, scanner=scanner).columns == docs.columns
    assert sorted(map(str, secret_scan.redact(docs, scanner=scanner).collect())) == sorted(map(str, docs.collect()))
    key = "AKIA" + "Q7WXB2MNPLK4RTY9"
    rows = spark.createDataFrame([(1, f"{key} {key}\x01{key}", None), (None, key, "x"), (3, None, "y"), (4, "a" * 100_000 + "1", "z")], "doc_id long, text string, source string")
    assert [r.text for r in secret_scan.redact(rows, scanner=scanner).orderBy("source").collect()][:2] == ["<SECRET> <SECRET>\x01<SECRET>", "<SECRET>"]
    assert secret_scan.scan(empty(spark), scanner=scanner).count() == 0 and secret_scan.redact(empty(spark), scanner=scanner).count() == 0
