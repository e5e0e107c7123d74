"""Labelled rows: a fold held out by doc_id and a bounded sample to learn from."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOLDS = 5


def held_out(doc_id: str = "doc_id") -> Column:
    """True for the fold that no label may be learned from; a null doc_id is held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(FOLDS)) == 0, F.lit(True))


def learning_sample(docs: DataFrame, labels: DataFrame, label: str, sample: tuple[int, int]) -> tuple[list[str], np.ndarray]:
    """(texts, labels): at most ``sample`` rows of label 0 and of label 1 outside the held-out fold, whole texts.

    The rows are those with the smallest hashes of their doc_id, so the sample
    is the same for any partitioning. Rows with two labels count by the larger.
    """
    known = labels.where(F.col(label).isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max(label).alias("y"))
    picked = [known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample[y]) for y in (0, 1)]
    picked = F.broadcast(picked[0].union(picked[1]))  # as many rows as the sample
    rows = docs.select("doc_id", "text").join(picked, "doc_id").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "y").collect()
    rows.sort(key=lambda r: (r["doc_id"], r["text"]))
    return [r["text"] for r in rows], np.array([r["y"] for r in rows], np.int64)


class Adam:
    def __init__(self, params: dict[str, np.ndarray], rate: float):
        self.params, self.rate, self.t = params, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in params.items()}
        self.v = {k: np.zeros_like(v) for k, v in params.items()}

    def step(self, grads: dict[str, np.ndarray]) -> None:
        self.t += 1
        for k, g in grads.items():
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.01 * (g * g - self.v[k])
            self.params[k] -= self.rate * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.99**self.t)) + 1e-9)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))
