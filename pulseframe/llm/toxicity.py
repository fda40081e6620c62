"""FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Per-coordinate learning rates and L1 leave few weights other than zero; the rest is a sorted pair
of arrays that every task gets (at most FIT_ROWS documents' features, in practice some thousands).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .ngrams import BITS, labelled_sample, logistic, score_documents, skip_grams
from .store import table
from .textops import slices

FIT_ROWS, THRESHOLD = 12_000, 0.3


def fit_ftrl(x: list[np.ndarray], y: np.ndarray, alpha: float = 2.0, beta: float = 1.0, l1: float = 6.0, l2: float = 0.0, passes: int = 8, seed: int = 11) -> tuple[np.ndarray, float]:
    """Weights (2**BITS, mostly zero) and intercept. The same input gives the same weights."""
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    bias_z = bias_n = 0.0
    rng = np.random.default_rng(seed)
    rate = min(max(float(y.mean()), 1e-3), 1 - 1e-3) if len(y) else 0.5
    prior = float(np.log(rate / (1 - rate)))

    def weights(zi, ni):
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2))

    for _ in range(passes):
        for i in rng.permutation(len(y)):
            at = x[i]
            zi, ni = z[at], n[at]
            w = weights(zi, ni)
            bias = prior - bias_z / ((beta + bias_n**0.5) / alpha + l2)
            g = float(logistic(w.sum() + bias)) - float(y[i])
            grown = ni + g * g
            z[at] = zi + g - (np.sqrt(grown) - np.sqrt(ni)) / alpha * w
            n[at] = grown
            bias_z += g - ((bias_n + g * g) ** 0.5 - bias_n**0.5) / alpha * (bias - prior)
            bias_n += g * g
    return weights(z, n), prior - bias_z / ((beta + bias_n**0.5) / alpha + l2)


class SparseLogistic:
    """The fitted model: what the non-zero weights give for (text numbers, features, texts)."""

    def __init__(self, x: list[np.ndarray], y: np.ndarray):
        weights, self.bias = fit_ftrl(x, y) if len(y) else (np.zeros(1 << BITS), 0.0)
        self.at = np.flatnonzero(weights)
        self.kept = weights[self.at].astype(np.float32)
        self.dense = None

    def __call__(self, of: np.ndarray, features: np.ndarray, n: int) -> np.ndarray:
        if self.dense is None:  # made once in each task
            self.dense = np.zeros(1 << BITS, np.float32)
            self.dense[self.at] = self.kept
        return logistic(np.bincount(of, weights=self.dense[features], minlength=n) + self.bias)


def toxicity_scores(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, held_out, score (probability of toxic) and predicted of every document.

    The model is fitted on at most `fit_rows` labelled rows outside the held-out quarter. Without
    labelled rows every score is 0.5. Null and empty texts get the intercept's score. Repeated rows stay and have equal scores; a
    very long text is scored whole; a score equal to the threshold counts as toxic; no rows give none; other columns are not read.
    """
    model = SparseLogistic(*labelled_sample(docs, labels, "toxic", fit_rows, skip_grams))
    return score_documents(docs, skip_grams, model, THRESHOLD)


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    """Toxicity score of every row of `documents`."""
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def reject_toxic(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the rows whose score stays under the threshold, all columns unchanged, in one pass
    without a shuffle. Without labelled rows nothing is rejected. Null and empty texts have the intercept's score; rows with a null
    doc_id are scored like others; repeated rows share their fate; a very long text is scored whole; an empty table stays empty;
    further columns are kept and not read."""
    x, y = labelled_sample(docs, table(spark, sf_dir, "labels"), "toxic", FIT_ROWS, skip_grams)
    if not len(y):
        return docs
    model = SparseLogistic(x, y)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield batch.filter(pa.array(model(*skip_grams(batch.column("text"))) < THRESHOLD))

    return docs.mapInArrow(run, docs.schema)
