"""The subpackage's registered queries: each applies an operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symsearch.llm import class_lm, decontamination, host_rules, oracles, packing, pairwise_quality, repeats, secret_scan, sharding, simhash, toxicity

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_bpe() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Junk, then toxic, then both at once; the ids with remainder 0 train nothing."""
    docs = table(spark, sf_dir, "documents")
    bad, toxic = F.col("quality") == 0, F.col("toxic") == 1
    chain = toxicity.fit_chain(docs, table(spark, sf_dir, "labels"), {"low_quality": bad, "toxic": toxic, "toxic_junk": bad & toxic}, ["quality", "toxic"])
    scored = toxicity.score_toxicity(docs, chain)
    return scored.select("doc_id", pairwise_quality.held_out("doc_id").alias("held_out"), "p_low_quality", "p_toxic", "p_toxic_junk", F.col("is_toxic").alias("toxic"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "nth", F.sha2("value", 256).alias("value_sha256"), F.char_length("value").alias("length"), "score", "is_secret")


def op4_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = class_lm.score(class_lm.fit(docs, training=class_lm.in_training("doc_id")))
    return scored.select("doc_id", (~class_lm.in_training("doc_id")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Also, which documents have a passage of 50 words or more that another one has too: it may be shorter than 400 bytes."""
    return repeats.remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "has_passage")


def op6_pairwise_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairwise_quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), word_bpe())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.octet_length("text").alias("n_bytes"))
    return sharding.place(docs)


def op10_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = host_rules.judge(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "verdict")


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_decontamination, op2_toxicity, op3_secret_scan, op4_class_lm, op5_suffix_dedup, op6_pairwise_quality, op7_simhash, op8_packing, op9_sharding, op10_host_rules)}


def oracle_sql() -> dict[str, str]:
    """For those that SQL can express; tests compare the others with brute force or held-out labels."""
    return {"op1_decontamination": oracles.OP1, "op9_sharding": oracles.op9(), "op10_host_rules": oracles.OP10}
