"""Secrets that no long run of token characters with a digit holds."""

import pytest

from symsearch.llm import secret_scan

JWT = "eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0NTY3ODkwIn0.dozjgNryP4J3jVmNHl0w5N_XgL0n3I9PlFUP0THsR8U"
MAIL = "SG.ngeVfQFYQlKU0ufo8x5d1A.TwL2iGABf9DHoTf09kqeF8tAmbihYzrnopKc1s5cr"
PATH = "services/T01A2B3C4D5/B01E6F7G8H9/aX7kQ2mZ9pL4vR8tY1wN3sB6"
SECRETS = [
    ('password = "{}"', "Tr0ub4dor&3"),
    ("password: {} and more", "hunter22"),
    ('secret = "{}"', "p@ss1W0rd!long#secret9"),
    ("passwd={}", "correcthorsebatterystaple"),
    ('api_key="{}"', "qmzkVtypNhwRbLxJcdGfSuaPeoWiKyTn"),
    ('{{"db_password": "{}"}}', "x9Kd!fw2#pLq"),
    ("db1_password={}", "kT7vq2Lm9x"),
    ("the mail key {} of", MAIL),
    ("was ya29.{}", None),
    ("Authorization: Bearer {}", JWT),
    ("see {}, then", JWT),
    ("send to https://hooks.host.example/{}", PATH),
    ("postgres://admin:{}@db.host.example/x", "q7Lm2xW9tr"),
]
PLAIN = ["the password: required for all", "password = os.environ.get(KEY)", "token: ${DB_PASSWORD}", "see https://www.host.example/blog/2023/how-to-bake-bread.html"]


@pytest.fixture(scope="module")
def scanner(spark):
    return secret_scan.learn(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))


def test_secrets_by_context_and_format(spark, scanner):
    values = [v or "ya29.a0AfH6SMBx7Qk2LmN9pRtVwZ3" for _, v in SECRETS]
    rows = [(i, t.format(v) if w else f"was {v}") for i, ((t, w), v) in enumerate(zip(SECRETS, values, strict=True))]
    docs = spark.createDataFrame([(i, t, "notes.txt") for i, t in rows], "doc_id long, text string, source string")
    found = {r.doc_id: r.value for r in secret_scan.scan(docs, scanner=scanner).where("is_secret").collect()}
    assert found == dict(enumerate(values))
    clean = {r.doc_id: r.text for r in secret_scan.redact(docs, scanner=scanner).collect()}
    assert clean == {i: t.replace(values[i], "<SECRET>") for i, t in rows}


def test_a_value_of_letters_in_order_is_judged(spark, scanner):
    docs = spark.createDataFrame([(1, 'api_key="abcdefghijklmnopqrstuvwxyzABCDEF"', "x")], "doc_id long, text string, source string")
    assert [r.value for r in secret_scan.scan(docs, scanner=scanner).collect()] == ["abcdefghijklmnopqrstuvwxyzABCDEF"]


def test_plain_values_and_paths_stay(spark, scanner):
    docs = spark.createDataFrame([(i, t, "notes.txt") for i, t in enumerate(PLAIN)], "doc_id long, text string, source string")
    assert [r.text for r in secret_scan.redact(docs, scanner=scanner).orderBy("doc_id").collect()] == PLAIN


def test_long_values_end(spark, scanner):
    texts = ["password=" + "a&" * 50_000, 'token = "' + "x.1" * 50_000 + '"', "https://host.example/" + "a/1" * 50_000, "://" * 50_000, "eyJ" + "a1.b" * 50_000]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    assert secret_scan.redact(docs, scanner=scanner).count() == len(texts)
    assert secret_scan.scan(docs, scanner=scanner).count() > 0
