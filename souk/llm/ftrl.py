"""FTRL-proximal logistic regression on sparse rows, fitted in shards.

The rows of a bounded sample are dealt to shards by a hash of their id; each
shard is one task that runs the per-coordinate FTRL-proximal updates over its
rows; the shards' weights are averaged with a Spark aggregate.  The model is a
dense array of ``dims`` floats whatever the size of the data.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fit_rows(index: list[np.ndarray], value: list[np.ndarray], y: np.ndarray, dims: int, alpha: float = 0.5,
             beta: float = 1.0, l1: float = 0.05, l2: float = 0.01, epochs: int = 4) -> np.ndarray:
    """Weights after ``epochs`` passes of single-row updates."""
    z, n = np.zeros(dims), np.zeros(dims)

    def weights(zi, ni):
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2))

    for _ in range(epochs):
        for i, x, t in zip(index, value, y, strict=True):
            zi, ni = z[i], n[i]
            w = weights(zi, ni)
            p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
            g = (p - t) * x
            nn = ni + g * g
            z[i] = zi + g - (np.sqrt(nn) - np.sqrt(ni)) / alpha * w
            n[i] = nn
    return weights(z, n)


def fit(rows: DataFrame, dims: int, shards: int = 4, **settings) -> np.ndarray:
    """rows: id, y, index (array<int>, distinct), value (array<float>)."""

    def train(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("order")
        w = fit_rows([np.asarray(x, np.int64) for x in pdf["index"]], [np.asarray(x, np.float64) for x in pdf["value"]],
                     pdf["y"].to_numpy(), dims, **settings)
        at = np.flatnonzero(w)
        return pd.DataFrame({"at": at.astype(np.int32), "w": w[at]})

    h = F.xxhash64(F.col("id").cast("string"), F.lit(11))
    dealt = rows.select(F.pmod(h, F.lit(shards)).alias("shard"), F.xxhash64(h, F.lit(5)).alias("order"), "y", "index", "value")
    seen = dealt.groupBy("shard").applyInPandas(train, "at int, w double")
    # a shard whose weight is zero sends no row: divide by the number of shards that had rows
    mean = seen.groupBy("at").agg(F.sum("w").alias("w")).toPandas()
    used = rows.select(F.pmod(h, F.lit(shards)).alias("shard")).distinct().count()
    out = np.zeros(dims, np.float32)
    out[mean["at"].to_numpy(np.int64)] = (mean["w"] / max(used, 1)).to_numpy(np.float32)
    return out
