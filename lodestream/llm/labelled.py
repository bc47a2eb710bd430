"""Bounded samples of labelled documents, for operators that learn from labels."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled documents that a model is fitted on, at most.
SAMPLE_ROWS = 12_000


def fold(key: Column, folds: int) -> Column:
    """crc32 of the key as text, modulo folds; null for a null key."""
    return F.crc32(F.encode(key.cast("string"), "UTF-8")) % folds


def sample(docs: DataFrame, labels: DataFrame, label: str, train: Column, key: str = "doc_id", text: str = "text", rows: int = SAMPLE_ROWS) -> DataFrame:
    """(_text, _label) of at most `rows` labelled documents for which train holds, chosen by a hash of the key.

    The chosen keys are a bounded table, so documents are filtered without a
    shuffle. Null labels and keys take no part; of a repeated key the largest
    label counts.
    """
    known = labels.select(F.col(key).alias("_key"), F.col(label).cast("int").alias("_label")).dropna().groupBy("_key").agg(F.max("_label").alias("_label"))
    known = known.join(docs.select(F.col(key).alias("_key")), "_key", "left_semi")
    chosen = known.where(train).orderBy(F.xxhash64("_key"), "_key").limit(rows)
    return docs.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text")).join(F.broadcast(chosen), "_key").select("_text", "_label")


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 40) -> np.ndarray:
    """Weights of a logistic model without intercept, by Newton's method with a ridge."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = sigmoid(x @ w)
        h = (x * (p * (1 - p))[:, None]).T @ x / len(y) + ridge * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (p - y) / len(y) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w
