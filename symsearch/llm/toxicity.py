"""Toxicity by a classifier chain.

The categories are predicted one after another.  Each has a linear (logistic)
model over the text's words and form, and over the probabilities of the
categories before it.  While training, those are out-of-fold predictions, made
by models that haven't seen the document, so a later model learns how far it can
trust the earlier ones on new texts; when scoring, the chain feeds itself.

The models are fitted on a bounded sample of labelled rows; every document is
scored where its text is read, with no shuffle.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symsearch.llm.common import LOWER, as_type, texts
from symsearch.llm.measures import MEASURES, measure
from symsearch.llm.pairwise_quality import labelled_rows

#: At most so many labelled rows train the chain; each model uses so many words of so many hash buckets.
LABELLED, WORDS, BUCKETS, FOLDS = 12_000, 512, 1 << 20, 5
#: A word is used if the share of positive documents among those that have it is so many standard deviations above chance.
CHANCE = 4.0
#: The square of what recall counts when a threshold is chosen, precision being 1.
BETA2 = 0.5
_EDGES = b".,;:!?()[]{}\"'`*_#$%&|<>"


def word_buckets(text: bytes) -> np.ndarray:
    """The buckets of a text's distinct words, in lower case and without the signs around them."""
    crc = zlib.crc32
    return np.unique(np.fromiter({crc(w.strip(_EDGES)) % BUCKETS for w in set(text.translate(LOWER).split())}, np.int64))


def _fit(x: np.ndarray, y: np.ndarray, ridge: float) -> np.ndarray:
    """Weights of a logistic model, the constant last, by Newton steps."""
    a = np.hstack((x, np.ones((len(x), 1))))
    w, penalty = np.zeros(a.shape[1]), np.full(a.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(20):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p) + 1e-9)[:, None]).T @ a + np.diag(penalty), a.T @ (p - y) + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-5:
            break
    return w


def _apply(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))


@dataclass
class Chain:
    categories: list[str]
    words: np.ndarray  #: sorted buckets that the models use
    mean: np.ndarray
    scale: np.ndarray
    weights: list[np.ndarray] = field(default_factory=list)
    thresholds: list[float] = field(default_factory=list)

    @classmethod
    def fit(cls, categories: list[str], buckets: list[np.ndarray], form: np.ndarray, labels: np.ndarray, fold: np.ndarray, ridge: float = 1.0) -> Chain:
        """labels: a column of 0 and 1 for each category; fold: of each row, below FOLDS.

        What is predicted of a fold comes from words and weights that are chosen
        without it.
        """
        n = len(form)
        chain = cls(categories, chosen_words(buckets, labels), form.mean(0) if n else np.zeros(form.shape[1]), form.std(0) + 1e-6 if n else np.ones(form.shape[1]))
        outs = [fold == k for k in range(FOLDS)]
        chains = [cls(categories, chosen_words([b for b, o in zip(buckets, out, strict=True) if not o], labels[~out]), chain.mean, chain.scale) for out in outs]
        x, earlier = chain.inputs(buckets, form), np.zeros((n, 0))
        for c in range(len(categories)):
            y = labels[:, c].astype(float)
            oof = np.zeros(n)
            for out, without in zip(outs, chains, strict=True):
                own = np.hstack((without.inputs(buckets, form), earlier))
                oof[out] = _apply(own[out], _fit(own[~out], y[~out], ridge))
            chain.weights.append(_fit(np.hstack((x, earlier)), y, ridge) if n else np.zeros(x.shape[1] + c + 1))
            chain.thresholds.append(best_threshold(oof, y))
            earlier = np.hstack((earlier, oof[:, None]))
        return chain

    def inputs(self, buckets: list[np.ndarray], form: np.ndarray) -> np.ndarray:
        x = np.zeros((len(buckets), len(self.words)))
        if len(self.words) and len(buckets):
            rows, flat = np.repeat(np.arange(len(buckets)), [len(b) for b in buckets]), np.concatenate(buckets)
            at = np.minimum(np.searchsorted(self.words, flat), len(self.words) - 1)
            own = self.words[at] == flat
            x[rows[own], at[own]] = 1
        return np.hstack((x, np.clip((form - self.mean) / self.scale, -4, 4) / 2))

    def predict(self, all_texts: list[bytes]) -> np.ndarray:
        """A column of probabilities for each category."""
        x = self.inputs([word_buckets(t) for t in all_texts], form_of(all_texts))
        for w in self.weights:
            x = np.hstack((x, _apply(x, w)[:, None]))
        return x[:, x.shape[1] - len(self.weights) :]


def chosen_words(buckets: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """The words whose share of positive rows is most above chance in any category: WORDS at most, sorted."""
    chosen: set[int] = set()
    n, categories = labels.shape
    rows = np.repeat(np.arange(n), [len(b) for b in buckets])
    names, index = np.unique(np.concatenate(buckets) if n else np.zeros(0, np.int64), return_inverse=True)
    df = np.bincount(index, minlength=len(names))
    for c in range(categories if n else 0):
        y = labels[:, c]
        rate = y.mean()
        positive = np.bincount(index, weights=y[rows], minlength=len(names))
        stray = (positive - df * rate) / np.sqrt(df * rate * (1 - rate) + 1.0)
        best = np.argsort(-stray, kind="stable")[: WORDS // categories]
        chosen.update(names[best[stray[best] >= CHANCE]].tolist())
    return np.array(sorted(chosen), np.int64)


def form_of(all_texts: list[bytes]) -> np.ndarray:
    return np.array([measure(t) for t in all_texts], float).reshape(-1, len(MEASURES))


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """Midway in the gap at which out-of-fold predictions have the best F-measure; above all of them if there are no positives."""
    if not len(y) or not y.any():
        return 2.0
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(y[order])
    # precision counts more than recall: clean documents are to be left alone
    f = (1 + BETA2) * hits / (np.arange(1, len(y) + 1) + BETA2 * y.sum())
    k = int(np.argmax(f))
    return float((p[order[k]] + (p[order[k + 1]] if k + 1 < len(p) else 0.0)) / 2)


def fit_chain(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], label_cols: list[str], *, id_col: str = "doc_id", text_col: str = "text", labelled: int = LABELLED, fold: int | None = 0) -> Chain:
    """Fit on at most ``labelled`` labelled rows of ``docs``.

    ``categories`` gives, in the chain's order, a 0/1 column of each category
    over ``label_cols``; a null label is 0.  ``fold``: ids with that CRC-32
    modulo 5 are held out (None: no ids).  Rows of one id all count, those with
    the lowest hashes of ids first; a null id has no label.  Without labelled
    rows the chain knows no word and finds nothing; empty and null texts are
    rows like any other.
    """
    names = list(categories)
    chosen = labelled_rows(labels, label_cols, fold=fold, most=labelled).select("doc", *(F.coalesce(c.cast("int"), F.lit(0)).alias(f"y{i}") for i, c in enumerate(categories.values())))
    rows = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "doc")  # at most ``labelled`` rows
    ys = [f"y{i}" for i in range(len(names))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_texts = texts(batch.column(0))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array([word_buckets(t).astype("<i4").tobytes() for t in all_texts], pa.binary()), pa.array([x.tobytes() for x in form_of(all_texts)], pa.binary())],
                names=["fold", "h", *ys, "buckets", "form"],
            )

    key = F.col("doc").cast("string").cast("binary")
    found = rows.select("text", (F.crc32(F.concat(key, F.lit(b"/fold"))) % FOLDS).cast("int").alias("fold"), F.xxhash64("doc").alias("h"), *ys).mapInArrow(run, ", ".join(["fold int", "h long", *(f"{y} int" for y in ys), "buckets binary", "form binary"]))
    # as repeated ids may give more rows: the same ones in each run
    got = found.orderBy("h", *ys, "buckets", "form").limit(2 * labelled).collect()
    return Chain.fit(
        names,
        [np.frombuffer(r.buckets, "<i4").astype(np.int64) for r in got],
        np.array([np.frombuffer(r.form) for r in got]).reshape(-1, len(MEASURES)),
        np.array([[r[y] for y in ys] for r in got], float).reshape(-1, len(names)),
        np.array([r.fold for r in got], np.int64),
    )


def score_toxicity(docs: DataFrame, chain: Chain, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ``p_<category>`` of each category, ``is_<category>`` of each) of each row of ``docs``.

    A null text is scored as an empty one.  Repeated rows are scored alike;
    other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(chain)  # WORDS weights for each category
    names = chain.categories

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            model, all_texts = shared.value, texts(batch.column(1))
            for a in range(0, len(all_texts), 2000):
                p = model.predict(all_texts[a : a + 2000])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, len(p)), *(pa.array(p[:, i]) for i in range(len(names))), *(pa.array(p[:, i] >= t) for i, t in enumerate(model.thresholds))],
                    names=[id_col, *(f"p_{n}" for n in names), *(f"is_{n}" for n in names)],
                )

    schema = ", ".join([f"{id_col} {as_type(docs.schema, id_col)}", *(f"p_{n} double" for n in names), *(f"is_{n} boolean" for n in names)])
    return docs.select(id_col, text_col).mapInArrow(run, schema)
