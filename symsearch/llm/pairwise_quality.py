"""A quality score learned from preferences between pairs of documents.

Bradley-Terry: the chance that document a is preferred to b is the logistic
function of score(a) - score(b), and the score is linear in what is measured of
the text.  Pairs of a labelled good and a labelled bad document are the
preferences; Newton steps minimize the logistic loss on their differences.  A
quantile of the training documents' scores is the threshold.

Texts are read once, to measure them.  Labels join the measures, not the texts,
and the scores are plain column arithmetic.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symsearch.llm.common import as_type, texts, written
from symsearch.llm.measures import MEASURES, measure

#: At most so many labelled rows, those whose ids hash lowest, and so many pairs of them train the model.
LABELLED, PAIRS = 20_000, 100_000
#: Documents that reach the threshold have this score or more.
AT_THRESHOLD = 0.3
CLIP = 5.0


@dataclass
class PairwiseModel:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float  #: the raw score that is mapped to AT_THRESHOLD
    quantile: float  #: its place among the training documents
    spread: float  #: raw score to one unit of log odds

    @classmethod
    def fit(cls, x: np.ndarray, label: np.ndarray, pairs: int = PAIRS, ridge: float = 1e-3, seed: int = 1) -> PairwiseModel:
        """With labels of one kind only, nothing is preferred: all weights are zero and every document reaches the threshold."""
        k = x.shape[1]
        if len(label) == 0 or label.min() == label.max():
            return cls(np.zeros(k), np.ones(k), np.zeros(k), 0.0, 0.0, 1.0)
        mean, scale = x.mean(0), x.std(0) + 1e-6
        z = np.clip((x - mean) / scale, -CLIP, CLIP)
        good, bad = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
        rng = np.random.default_rng(seed)
        d = z[rng.choice(good, pairs)] - z[rng.choice(bad, pairs)]
        w = np.zeros(k)
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(d @ w, -500, 500)))
            step = np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d / pairs + ridge * np.eye(k), ridge * w - d.T @ (1 - p) / pairs)
            w -= step
            if np.abs(step).max() < 1e-6:
                break
        s = z @ w
        # the quantile with the fewest errors, the middle one of equals
        ranked = np.sort(s)
        order = label[np.argsort(s, kind="stable")]
        errors = np.concatenate(([0], np.cumsum(order == 1))) + np.concatenate((np.cumsum((order == 0)[::-1])[::-1], [0]))
        best = np.flatnonzero(errors == errors.min())
        cut = int(best[len(best) // 2])
        low, high = ranked[max(cut - 1, 0)], ranked[min(cut, len(ranked) - 1)]
        return cls(mean, scale, w, float((low + high) / 2), cut / len(ranked), float(max(s.std() / 3, 1e-6)))

    def raw(self, columns: list[Column]) -> Column:
        out = F.lit(0.0)
        for c, m, d, w in zip(columns, self.mean.tolist(), self.scale.tolist(), self.weights.tolist(), strict=True):
            out = out + F.lit(w) * F.greatest(F.lit(-CLIP), F.least(F.lit(CLIP), (c - F.lit(m)) / F.lit(d)))
        return out

    def score(self, columns: list[Column]) -> Column:
        """0 to 1, and just AT_THRESHOLD at the threshold (a billionth more, so that rounding can't make it less)."""
        shift = float(np.log((AT_THRESHOLD + 1e-9) / (1 - AT_THRESHOLD)))
        return 1 / (1 + F.exp(-((self.raw(columns) - F.lit(self.threshold)) / F.lit(self.spread) + F.lit(shift))))


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, MEASURES) of each row, written to the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([measure(t) for t in texts(batch.column(1))], float).reshape(-1, len(MEASURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x[:, i]) for i in range(len(MEASURES)))], names=["doc", *MEASURES])

    chosen = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    return written(chosen.mapInArrow(run, ", ".join([f"doc {as_type(docs.schema, id_col)}", *(f"{m} double" for m in MEASURES)])), "measures")


def held_out(id_col: str | Column, folds: int = 5, fold: int = 0) -> Column:
    """Whether a row is kept from training: by the CRC-32 of its id's text (false for a null id)."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % folds == fold, F.lit(False))


def labelled_rows(labels: DataFrame, label_cols: list[str], id_col: str = "doc_id", fold: int | None = 0, most: int = LABELLED) -> DataFrame:
    """(doc, label columns) of at most ``most`` training rows, one for each id, those whose ids hash lowest."""
    rows = labels.select(F.col(id_col).alias("doc"), *label_cols).where(F.col("doc").isNotNull() & F.coalesce(*(F.col(c) for c in label_cols)).isNotNull())
    if fold is not None:
        rows = rows.where(~held_out("doc", fold=fold))
    one = rows.groupBy("doc").agg(*(F.max(c).alias(c) for c in label_cols))
    return one.orderBy(F.xxhash64("doc"), "doc").limit(most)


def score_quality(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", labelled: int = LABELLED, pairs: int = PAIRS) -> DataFrame:
    """(id, ``held_out``, ``score``, ``predicted``) of each row of ``docs``.

    A null text is scored as an empty one.  A label counts once for each row of
    ``docs`` with its id; rows with a null id or label train nothing.  Of
    several labels of one id the largest counts.  Repeated rows are scored
    alike.  No label, or labels of one kind: all scores are AT_THRESHOLD.
    """
    facts = measured(docs, id_col, text_col)
    train = facts.join(F.broadcast(labelled_rows(labels, [label_col], most=labelled)), "doc")  # at most ``labelled`` rows
    rows = train.orderBy(F.xxhash64("doc"), "doc", *MEASURES).select(label_col, *MEASURES).limit(2 * labelled).collect()
    x = np.array([tuple(r)[1:] for r in rows], float).reshape(-1, len(MEASURES))
    model = PairwiseModel.fit(x, np.array([int(r[0]) for r in rows]), pairs)
    score = model.score([F.col(m) for m in MEASURES])
    scored = facts.select(F.col("doc").alias(id_col), held_out("doc").alias("held_out"), score.alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= AT_THRESHOLD).cast("int"))
