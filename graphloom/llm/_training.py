"""Bounded training samples from labels, and small models fitted with NumPy on the driver."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labelled rows that a classifier is fitted on at most; taken in the order of a hash of the id.
SAMPLE_ROWS = 20_000


def held_out(doc_id) -> F.Column:
    """The third of the ids that no classifier learns from."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(3)) == 1, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, rows: int = SAMPLE_ROWS) -> DataFrame:
    """text and label (0/1) of at most `rows` labelled documents outside the held-out third.

    An id that is labelled more than once has its highest label, one with several documents the least of
    their texts; so `rows` bounds what comes back whatever the tables hold.  The sampled labels are broadcast,
    and only the sampled documents are shuffled.
    """
    usable = labels.select("doc_id", F.col(label).cast("int").alias("label")).where("doc_id IS NOT NULL AND label IN (0, 1)").where(~held_out("doc_id"))
    chosen = usable.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    found = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    return found.groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("text", "label")


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Logistic:
    """Logistic regression with an L2 penalty, by Newton steps."""

    def __init__(self, x: np.ndarray, y: np.ndarray, penalty: float = 1.0, steps: int = 30) -> None:
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-9
        z = np.column_stack([(x - self.mean) / self.scale, np.ones(len(x))])
        ridge = penalty * np.eye(z.shape[1])
        ridge[-1, -1] = 1e-6
        w = np.zeros(z.shape[1])
        for _ in range(steps):
            p = sigmoid(z @ w)
            step = np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + ridge, z.T @ (y - p) - ridge @ w)
            w += step
            if np.abs(step).max() < 1e-6:
                break
        self.weights = w

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(np.column_stack([(x - self.mean) / self.scale, np.ones(len(x))]) @ self.weights)
