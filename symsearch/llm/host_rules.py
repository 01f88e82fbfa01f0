"""Quality rules with verdicts on hosts.

Each document is measured and tried against a few rules.  Failures are added up
by host; the host's failure rate is shrunk toward the corpus with a beta prior
that is fitted to the hosts themselves by the method of moments, so that a host
with three bad pages of three is not yet a bad host.  The host's verdict then
goes back to its documents:

* ``bad`` (shrunk rate at least ``bad_rate``): all documents of the host go,
* ``trusted`` (shrunk rate below ``trusted_rate``): only documents that fail a
  base rule go,
* ``normal`` otherwise: documents that fail any rule go.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from symsearch.llm.common import as_type, texts, unused, written

SYMBOLS = b"#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")

#: Production parameters.
BAD_RATE, TRUSTED_RATE = 0.6, 0.02
#: The prior never counts for more documents than this.
MOST_PRIOR = 1e6


def measure(text: bytes) -> tuple[int, int, int, int, int, int]:
    """The MEASURES of a text."""
    words = text.split()
    chars = len(text.decode("utf-8", "replace")) - (len(text) - sum(map(len, words)))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    repeated = 0
    windows = list(zip(words, words[1:], words[2:]))  # noqa: B905
    if len(set(windows)) < len(windows):
        times, end = Counter(windows), 0
        for i, w in enumerate(windows):
            if times[w] > 1:
                repeated += i + 3 - max(i, end)
                end = i + 3
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated, len(lines)


def measured(docs: DataFrame, keep: list[str], text_col: str) -> DataFrame:
    """The columns ``keep`` of ``docs`` and the MEASURES of its text."""
    types = [f"k{i} {as_type(docs.schema, c)}" for i, c in enumerate(keep)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [measure(t) for t in texts(batch.column(len(keep)))]
            columns = [pa.array(x, pa.int64()) for x in zip(*rows, strict=True)] or [pa.array([], pa.int64())] * len(MEASURES)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], names=[*(f"k{i}" for i in range(len(keep))), *MEASURES])

    chosen = docs.select(*(F.col(c).alias(f"k{i}") for i, c in enumerate(keep)), F.col(text_col).cast("string").alias("t"))
    return chosen.mapInArrow(run, ", ".join([*types, *(f"{m} long" for m in MEASURES)]))


def base_failed() -> Column:
    """Under 50 words, or over half of them in repeated windows of three."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def rule_failed() -> Column:
    """Over one symbol in ten words, over half of the lines repeated, or words of under 2 or over 15 characters on average."""
    return (10 * F.col("n_symbols") > F.col("n_words")) | (2 * F.col("n_dup_lines") > F.col("n_lines")) | (F.col("word_chars") < 2 * F.col("n_words")) | (F.col("word_chars") > 15 * F.col("n_words"))


def host_verdicts(facts: DataFrame, host_col: str, bad_rate: float = BAD_RATE, trusted_rate: float = TRUSTED_RATE) -> DataFrame:
    """(host_col, n_docs, n_failed, rate, verdict) of each host in ``facts`` (which has the MEASURES).

    A null host gets no verdict.  With one host, or hosts that differ no more
    than chance has it, the prior is as strong as MOST_PRIOR documents.
    """
    failed = F.when(base_failed() | rule_failed(), 1).otherwise(0)
    hosts = facts.where(F.col(host_col).isNotNull()).groupBy(host_col).agg(F.count(F.lit(1)).alias("n_docs"), F.sum(failed).alias("n_failed"))
    hosts = written(hosts, "hosts")
    p = F.col("n_failed") / F.col("n_docs")
    k, n, f, pp = hosts.agg(F.count(F.lit(1)), F.sum("n_docs"), F.sum("n_failed"), F.sum(p * F.col("n_failed"))).first()
    alpha, beta = beta_prior(k or 0, n or 0, f or 0, pp or 0.0)
    rate = (F.col("n_failed") + F.lit(alpha)) / (F.col("n_docs") + F.lit(alpha + beta))
    return hosts.withColumn("rate", rate).withColumn("verdict", F.when(rate >= bad_rate, "bad").when(rate < trusted_rate, "trusted").otherwise("normal"))


def beta_prior(hosts: int, docs: int, failed: int, squares: float) -> tuple[float, float]:
    """Alpha and beta by moments; ``squares`` is the sum over hosts of documents times squared rate."""
    if not docs:
        return 0.0, MOST_PRIOR
    mean = failed / docs
    within = mean * (1 - mean)
    between = squares / docs - mean * mean - (hosts - 1) * within / docs
    strength = min(MOST_PRIOR, max(1.0, within / between - 1)) if between > within / MOST_PRIOR else MOST_PRIOR
    return mean * strength, (1 - mean) * strength


def judge(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", bad_rate: float = BAD_RATE, trusted_rate: float = TRUSTED_RATE) -> DataFrame:
    """One row for each row of ``docs``: id, host, MEASURES, ``base_failed``, ``rule_failed``, ``rate``, ``verdict``, ``kept``.

    A null or empty text has no words and so fails a base rule.  Documents with
    a null host are judged as those of a normal host.  Repeated rows count, and
    are returned, as often as they occur.  Other columns are not read.
    """
    facts = written(measured(docs, [id_col, host_col], text_col), "host-rules").withColumnsRenamed({"k0": "doc", "k1": "host"})
    verdicts = host_verdicts(facts, "host", bad_rate, trusted_rate).select("host", "rate", "verdict")
    out = facts.join(verdicts, "host", "left").withColumn("verdict", F.coalesce("verdict", F.lit("normal"))).withColumn("base_failed", base_failed()).withColumn("rule_failed", rule_failed())
    kept = ~F.col("base_failed") & (F.col("verdict") != "bad") & ((F.col("verdict") == "trusted") | ~F.col("rule_failed"))
    return out.select(F.col("doc").alias(id_col), F.col("host").alias(host_col), *MEASURES, "base_failed", "rule_failed", "rate", "verdict", kept.alias("kept"))


def keep_good(docs: DataFrame, *, text_col: str = "text", host_col: str = "source", bad_rate: float = BAD_RATE, trusted_rate: float = TRUSTED_RATE) -> DataFrame:
    """The rows of ``docs`` that :func:`judge` keeps, with all their columns, as they are.

    The first pass gathers the hosts' failures.  The second one measures again
    and filters where the text is read, so that no text is shuffled unless there
    are too many bad or trusted hosts to broadcast.
    """
    columns = docs.columns
    verdicts = host_verdicts(measured(docs, [host_col], text_col), "k0", bad_rate, trusted_rate)
    # written, so that Spark knows its size when it chooses the join
    special = written(verdicts.where("verdict != 'normal'").select(F.col("k0").alias("host"), "verdict"), "special-hosts")
    at = columns.index(text_col)
    soft_, host_, verdict_ = (unused(x, columns) for x in ("soft", "host", "verdict"))
    names = [*columns, soft_]
    special = special.withColumnsRenamed({"host": host_, "verdict": verdict_})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hard, soft = [], []
            for n, chars, symbols, dup, rep, lines in map(measure, texts(batch.column(at))):
                hard.append(n < 50 or 100 * rep > 50 * n)
                soft.append(10 * symbols > n or 2 * dup > lines or chars < 2 * n or chars > 15 * n)
            keep = pa.array([not x for x in hard], pa.bool_())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(soft, pa.bool_())], names=names).filter(keep)

    tried = docs.mapInArrow(run, T.StructType([*docs.schema, T.StructField(soft_, T.BooleanType())]))
    joined = tried.join(special, tried[host_col] == special[host_], "left")
    verdict = F.coalesce(special[verdict_], F.lit("normal"))
    return joined.where((verdict != "bad") & ((verdict == "trusted") | ~tried[soft_])).select(*(tried[c] for c in columns))
