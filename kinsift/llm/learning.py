"""Samples to learn from, and small numpy learners that run on them.

Learners see a bounded number of rows, which is a parameter; everything that is counted or scored
covers all rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from kinsift.llm.common import held_out
from kinsift.storage import materialize


def sample(docs: DataFrame, labels: DataFrame, label: str, labelled: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, y) of at most `labelled` rows with a label (y 0 or 1).

    None of them is held out. Which rows: those with the lowest hashes of their ids, so the same in every
    run. Of rows that repeat an id one is taken; of labels that repeat one, the larger. Other labels than
    0 and 1 count as none.
    """
    known = labels.where(F.col(label).isin(0, 1)).groupBy(F.col("doc_id").alias("k")).agg(F.max(label).cast("int").alias("y"))
    chosen = known.where(~held_out(F.col("k")) & F.col("k").isNotNull()).orderBy(F.xxhash64("k"), "k").limit(labelled)
    chosen = F.broadcast(materialize(chosen, "chosen"))  # at most `labelled` rows
    rows = docs.select(F.col(id_col).alias("k"), F.col(text_col).alias("text")).join(chosen, "k")
    return materialize(rows.groupBy(F.col("k").alias("id")).agg(F.min("text").alias("text"), F.first("y").alias("y")), "sample")


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def lasso_logistic(x: np.ndarray, y: np.ndarray, strength: float, rounds: int = 300) -> tuple[np.ndarray, float]:
    """Weights and intercept that minimize the mean log loss plus strength * sum |w|, by accelerated proximal steps."""
    n, m = x.shape
    a = np.concatenate([x, np.ones((n, 1), x.dtype)], axis=1)
    v = np.ones(m + 1)
    for _ in range(20):  # the largest eigenvalue bounds the step
        v = a.T @ (a @ v)
        v /= np.linalg.norm(v) or 1
    step = 4 * n / max(float(np.linalg.norm(a.T @ (a @ v))), 1e-9)
    w = np.zeros(m + 1)
    rate = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    w[m] = np.log(rate / (1 - rate))
    z, t = w.copy(), 1.0
    for _ in range(rounds):
        new = z - step * (a.T @ (sigmoid(a @ z) - y)) / n
        new[:m] = np.sign(new[:m]) * np.maximum(np.abs(new[:m]) - step * strength, 0)
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        z = new + (t - 1) / t2 * (new - w)
        w, t = new, t2
    return w[:m], float(w[m])


def sparse_logistic(rows: np.ndarray, cols: np.ndarray, n: int, m: int, y: np.ndarray, l2: float = 1e-4, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Weights and intercept of an L2 logistic regression on m binary features; (rows, cols) are where they are 1."""
    w, g2, b, b2 = np.zeros(m), np.full(m, 1e-6), 0.0, 1e-6
    rate = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    b = float(np.log(rate / (1 - rate)))
    for _ in range(rounds):  # steps scaled by the gradients so far
        error = sigmoid(b + np.bincount(rows, w[cols], n)) - y
        gradient = np.bincount(cols, error[rows], m) / n + l2 * w
        g2 += gradient**2
        w -= 0.5 * gradient / np.sqrt(g2)
        db = float(error.mean())
        b2 += db * db
        b -= 0.2 * db / b2**0.5
    return w, b
