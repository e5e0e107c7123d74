"""Vector arithmetic on array columns, in the JVM; matrices as a pandas UDF."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _double(x: Column) -> Column:
    return x.cast("array<double>")


def total(x: Column) -> Column:
    return F.aggregate(_double(x), F.lit(0.0), lambda a, b: a + b)


def dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(_double(x), _double(y), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)


def norm(x: Column) -> Column:
    return F.sqrt(dot(x, x))


def cosine(x: Column, y: Column) -> Column:
    """Null for a zero vector."""
    both = norm(x) * norm(y)
    return F.when(both > 0, dot(x, y) / both)


def softmax(x: Column) -> Column:
    e = F.transform(_double(x), lambda v: F.exp(v - F.array_max(_double(x))))
    return F.transform(e, lambda v: v / total(e))


def sigmoid(x: Column) -> Column:
    return F.transform(_double(x), lambda v: 1 / (1 + F.exp(-v)))


def gelu(x: Column) -> Column:
    k = float(np.sqrt(2 / np.pi))
    return F.transform(_double(x), lambda v: 0.5 * v * (1 + F.tanh(k * (v + 0.044715 * v * v * v))))


def layer_norm(x: Column, epsilon: float = 1e-5) -> Column:
    mean = total(x) / F.size(x)
    centred = F.transform(_double(x), lambda v: v - mean)
    spread = F.sqrt(dot(centred, centred) / F.size(x) + epsilon)
    return F.transform(centred, lambda v: v / spread)


def matmul_udf(rows: int, inner: int, cols: int):
    """(rows*inner, inner*cols) flattened arrays to rows*cols."""

    @F.pandas_udf("array<double>")
    def product(a: pd.Series, b: pd.Series) -> pd.Series:
        x, y = np.stack(a.to_list()).reshape(-1, rows, inner), np.stack(b.to_list()).reshape(-1, inner, cols)
        return pd.Series((x @ y).reshape(len(x), -1).tolist())

    return product


def attention_udf(heads: int, dims: int):
    """Scaled dot-product attention of flattened (tokens, dims) arrays q, k, v."""

    @F.pandas_udf("array<double>")
    def attend(q: pd.Series, k: pd.Series, v: pd.Series) -> pd.Series:
        out = []
        for row in zip(q, k, v):
            a, b, c = (np.asarray(x, float).reshape(-1, heads, dims // heads).transpose(1, 0, 2) for x in row)
            score = a @ b.transpose(0, 2, 1) / np.sqrt(dims // heads)
            weight = np.exp(score - score.max(-1, keepdims=True))
            out.append(((weight / weight.sum(-1, keepdims=True)) @ c).transpose(1, 0, 2).ravel().tolist())
        return pd.Series(out)

    return attend
