"""Fitting helpers for operators that learn from the ``labels`` table."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import crc_mod


def training_labels(labels: DataFrame, label: str, mod: int, held: int) -> DataFrame:
    """``doc_id, y`` of the usable training rows: label 0 or 1, id known, not in the held-out fold."""
    y = F.col(label).cast("int")
    return labels.where(y.isin(0, 1) & F.col("doc_id").isNotNull() & (crc_mod("doc_id", mod) != held)).select(
        F.col("doc_id").cast("bigint").alias("doc_id"), y.alias("y"))


def sample_documents(docs: DataFrame, training: DataFrame, per_class: int) -> DataFrame:
    """``doc_id, y, text`` of at most ``per_class`` training ids of each label (smallest id hashes first), a row
    each: of several rows of one id the smallest text stands for it, reduced before the shuffle.

    The ids are bounded by the parameter, so they may be broadcast to the scan of the texts."""
    training = training.distinct()
    parts = [training.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for y in (0, 1)]
    ids = parts[0].union(parts[1])
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(F.broadcast(ids), "doc_id")
    return rows.groupBy("doc_id", "y").agg(F.min("text").alias("text"))


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -60, 60)))


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = 1e-2, steps: int = 60) -> np.ndarray:
    """Logistic regression by damped Newton steps; the last coefficient is the intercept.

    Without rows of both labels the intercept alone answers with the smoothed share of label 1."""
    weight = np.ones(len(y)) if weight is None else weight
    a = np.column_stack([x, np.ones(len(y))])
    b = np.zeros(a.shape[1])
    ones, total = float(weight[y == 1].sum()), float(weight.sum())
    b[-1] = np.log((ones + 0.5) / (total - ones + 0.5))
    if not 0 < ones < total:
        return b
    penalty = np.full(a.shape[1], ridge)
    penalty[-1] = 1e-6

    def loss(v):
        z = a @ v
        return float((weight * (np.logaddexp(0, z) - y * z)).sum() + 0.5 * (penalty * v * v).sum())

    now = loss(b)
    for _ in range(steps):
        p = sigmoid(a @ b)
        gradient = a.T @ (weight * (p - y)) + penalty * b
        hessian = (a * (weight * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ a + np.diag(penalty)
        step, scale = np.linalg.solve(hessian, gradient), 1.0
        while scale > 1e-4 and loss(b - scale * step) > now:
            scale /= 2
        b = b - scale * step
        new = loss(b)
        if now - new < 1e-9 * max(1.0, abs(now)):
            break
        now = new
    return b
