"""Naive Bayes support vectors: n-gram indicators scaled by class log-count ratios, and a linear
hinge-loss model fitted on them by dual coordinate descent."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from .ngrams import BITS, labelled_sample, logistic, score_documents, shape_grams
from .store import table

FIT_ROWS, THRESHOLD = 8_000, 0.7


def count_ratios(x: list[np.ndarray], y: np.ndarray, smooth: float = 1.0) -> np.ndarray:
    """log((p / |p|) / (q / |q|)) of every feature, p and q the smoothed document counts of both classes."""
    total = [np.full(1 << BITS, smooth), np.full(1 << BITS, smooth)]
    for at, label in zip(x, y):
        total[label][at] += 1
    seen = (total[0] + total[1]) > 2 * smooth
    return np.where(seen, np.log(total[1] / (smooth + (y == 1).sum())) - np.log(total[0] / (smooth + (y == 0).sum())), 0.0)


def fit_hinge(x: list[np.ndarray], scaled: list[np.ndarray], y: np.ndarray, cost: float = 1.0, passes: int = 8, seed: int = 5) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the L2-regularised hinge loss, classes weighted evenly; weights and bias."""
    sign = np.where(y > 0, 1.0, -1.0)
    w, bias = np.zeros(1 << BITS), 0.0
    alpha = np.zeros(len(y))
    upper = cost * len(y) / (2 * np.where(y > 0, max(1, (y > 0).sum()), max(1, (y == 0).sum())))
    square = np.array([v @ v + 1.0 for v in scaled])
    rng = np.random.default_rng(seed)
    for _ in range(passes):
        most = 0.0
        for i in rng.permutation(len(y)):
            at, v = x[i], scaled[i]
            slope = sign[i] * (w[at] @ v + bias) - 1
            new = min(max(alpha[i] - slope / square[i], 0.0), upper[i])
            step = (new - alpha[i]) * sign[i]
            if step:
                w[at] += step * v
                bias += step
                alpha[i] = new
                most = max(most, abs(step))
        if most < 1e-3:
            break
    return w, bias


def fit_sigmoid(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve from margins to probabilities, by Newton's method on
    smoothed targets."""
    up, down = (y > 0).sum(), (y == 0).sum()
    target = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    a, b = 1.0, float(np.log((up + 1) / (down + 1)))
    for _ in range(50):
        p = logistic(a * margin + b)
        g, v = p - target, np.maximum(p * (1 - p), 1e-9)
        h = np.array([[v @ (margin * margin) + 1e-6, v @ margin], [v @ margin, v.sum() + 1e-6]])
        step = np.linalg.solve(h, np.array([g @ margin + 1e-6 * a, g.sum()]))
        step *= min(1.0, 2.0 / max(1e-12, np.abs(step).max()))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-7:
            break
    return max(a, 1e-3), b


class NaiveBayesVectors:
    def __init__(self, x: list[np.ndarray], y: np.ndarray, calibration: int = 5):
        """Every `calibration`-th row is kept from the fit and sets the curve from margins to scores."""
        self.at, self.weight, self.ratio, self.bias, self.curve = np.zeros(0, np.int64), np.zeros(0, np.float32), np.zeros(0, np.float32), 0.0, (1.0, 0.0)
        self.dense = None
        if not len(y) or y.min() == y.max():
            self.curve = (1.0, 0.0 if not len(y) else 4.0 * (2 * int(y[0]) - 1))
            return
        aside = np.arange(len(y)) % calibration == 0
        fit = np.flatnonzero(~aside)
        if len(y) < 50 or y[fit].min() == y[fit].max():
            fit = np.arange(len(y))
        ratio = count_ratios([x[i] for i in fit], y[fit])
        scaled = [self._scale(ratio[x[i]]) for i in fit]
        w, self.bias = fit_hinge([x[i] for i in fit], scaled, y[fit])
        self.at = np.flatnonzero(ratio)
        self.weight, self.ratio = (w * ratio)[self.at].astype(np.float32), ratio[self.at].astype(np.float32)
        margin = np.array([w[v] @ self._scale(ratio[v]) + self.bias for v in x])
        self.curve = fit_sigmoid(margin[aside], y[aside]) if len(np.unique(y[aside])) == 2 else (1.0, 0.0)

    @staticmethod
    def _scale(v: np.ndarray) -> np.ndarray:
        return v / max(1e-9, float(np.sqrt(v @ v)))

    def __call__(self, of: np.ndarray, features: np.ndarray, n: int) -> np.ndarray:
        if self.dense is None:  # made once in each task
            self.dense = np.zeros((2, 1 << BITS), np.float32)
            self.dense[:, self.at] = self.weight, self.ratio
        weight, ratio = self.dense
        norm = np.sqrt(np.bincount(of, weights=ratio[features].astype(np.float64) ** 2, minlength=n))
        margin = np.bincount(of, weights=weight[features], minlength=n) / np.maximum(norm, 1e-9) + self.bias
        return logistic(self.curve[0] * margin + self.curve[1])


def quality_scores(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, held_out, score (probability of label 1) and predicted of every document.

    The model is fitted on at most `fit_rows` labelled rows outside the held-out quarter. Without
    labelled rows every score is 0.5; with one class alone it is that class's. Null and empty texts get
    the bias's score. Repeated rows stay and have equal scores; a very long text is scored whole; a score equal to the threshold
    counts as 1; no rows give none; other columns are not read.
    """
    model = NaiveBayesVectors(*labelled_sample(docs, labels, "quality", fit_rows, shape_grams))
    return score_documents(docs, shape_grams, model, THRESHOLD)


def op9_quality(spark, sf_dir: str) -> DataFrame:
    """Quality score of every row of `documents`."""
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
