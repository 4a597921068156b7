"""Bounded labelled samples on the driver, and small calibrated models in numpy."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held: int, most: int) -> list[tuple[str, int]]:
    """(text, label) of at most `most` labelled rows a label, those least by a hash of the id, outside the held-out fold.

    The ids come from `labels` alone; at most 2 * most of them are broadcast to find their texts in one scan. Null labels, ids
    and texts are left out. Ids are compared as strings, so both tables may hold them in any type. Ids that repeat in `labels` count once, with their greatest label; of rows that share an id, the least text.
    """
    spark = docs.sparkSession
    marks = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (fold("doc_id", modulus) != held)).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    marks = marks.select("doc_id", "y", F.xxhash64("doc_id").alias("h"))
    chosen = [(str(r["doc_id"]), r["y"]) for y in (0, 1) for r in marks.filter(F.col("y") == y).orderBy("h", "doc_id").limit(most).collect()]
    if not chosen:
        return []
    ids = spark.createDataFrame(chosen, "__id string, y int")
    texts = docs.select(F.col("doc_id").cast("string").alias("__id"), F.col("text").cast("string").alias("__text")).filter(F.col("__text").isNotNull())
    got = texts.join(F.broadcast(ids), "__id").groupBy("__id", "y").agg(F.min("__text").alias("__text")).collect()
    return [(r["__text"], r["y"]) for r in sorted(got, key=lambda r: (r["y"], len(r["__id"]), r["__id"]))]


class Logistic:
    """Logistic regression by Newton steps on standardised features, with a small ridge; class sizes are re-weighted to `prior`."""

    def __init__(self, x: np.ndarray, y: np.ndarray, prior: float | None = None, ridge: float = 1e-2):
        self.mean, self.std = x.mean(0), x.std(0) + 1e-9
        z, share = self._design(x), y.mean()
        w = np.ones(len(y)) if prior is None or not 0 < share < 1 else np.where(y == 1, prior / share, (1 - prior) / (1 - share))
        self.coef = np.zeros(z.shape[1])
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(z @ self.coef, -30, 30)))
            g = z.T @ (w * (p - y)) + ridge * len(y) * 1e-2 * self.coef
            h = (z * (w * p * (1 - p))[:, None]).T @ z + ridge * len(y) * 1e-2 * np.eye(z.shape[1])
            step = np.linalg.solve(h, g)
            self.coef -= step
            if np.abs(step).max() < 1e-7:
                break

    def _design(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.std, -8, 8)
        return np.column_stack([np.ones(len(z)), z])

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self._design(x) @ self.coef, -30, 30)))
