"""Quality classifier: hashed word n-gram logistic regression fitted with
follow-the-regularised-leader updates (``ftrl``), scored as sparse dot products.

Tokens are runs of letters, digits and bytes above ASCII, and runs of other
non-blank characters.  Features are hashed into ``DIMS`` columns: n-grams
(n = 1, 2) of the lower-cased tokens, and n-grams (n = 1, 2, 3) of the tokens'
word classes (lower case, capitalised, upper case, with digits, each run of
other characters, and "the token before, again"), so that the shape of unseen
words counts as well.  A text's row is the square root of each column's count,
scaled to length one, plus a bias.

Defined cases: null and empty texts have the bias alone; rows without a label
or text are not learned from; if one class has no row, every score is that of
the smoothed label mean; other columns are ignored, repeated rows are scored
each, an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from souk.llm import ftrl
from souk.llm.common import hash_words, lowered, mix, not_space, slices, text_buffer

#: Columns of the hashed features; the model holds one float for each.
DIMS = 1 << 18
BIAS = 0


def _tokens(data: np.ndarray, offsets: np.ndarray):
    """(word hash, class, row) of every token, in order."""
    word = ((data >= 48) & (data <= 57)) | ((data >= 65) & (data <= 90)) | ((data >= 97) & (data <= 122)) | (data >= 128)
    other = not_space(data) & ~word
    h1, r1, s1 = hash_words(lowered(data), offsets, word)
    h2, r2, s2 = hash_words(data, offsets, other)
    order = np.argsort(np.concatenate((s1, s2)), kind="stable")
    if not len(order):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def runs(mask):  # how many bytes of the mask lie in each word token
        total = np.concatenate(([0], np.cumsum(mask & word)))
        ends = np.append(s1[1:], len(data))
        return total[ends] - total[s1]

    if len(s1):
        n, upper, digits = runs(word), runs((data >= 65) & (data <= 90)), runs((data >= 48) & (data <= 57))
        lower_high = n - upper - digits
        first_upper = (data[s1] >= 65) & (data[s1] <= 90)
        kind = np.where(digits > 0, 4, np.where(upper == 0, 1, np.where(first_upper & (upper == 1) & (lower_high > 0), 2,
                        np.where(upper >= lower_high, 3, 5)))).astype(np.uint64)
    else:
        kind = np.zeros(0, np.uint64)
    h = np.concatenate((h1, h2))[order]
    k = np.concatenate((kind, h2 | np.uint64(1 << 60)))[order]
    r = np.concatenate((r1, r2))[order]
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (r[1:] == r[:-1])
    k[again] = np.uint64(9)
    return h, k, r


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct columns of each row, row by row; their values; row offsets."""
    n_rows = len(offsets) - 1
    h, k, r = _tokens(data, offsets)
    ids, rows = [], []
    for tokens, salt, top in ((h, 101, 2), (k, 202, 3)):
        g = np.full(len(tokens), np.uint64(salt), np.uint64)
        for n in range(1, top + 1):
            m = len(tokens) - n + 1
            if m <= 0:
                break
            g = mix((g[:m] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15) ^ tokens[n - 1:])
            same = r[:m] == r[n - 1:]
            ids.append((g[same] % np.uint64(DIMS - 1)).astype(np.int64) + 1)
            rows.append(r[:m][same])
    ids.append(np.full(n_rows, BIAS, np.int64))
    rows.append(np.arange(n_rows))
    key = np.concatenate(rows) * DIMS + np.concatenate(ids)
    key, n = np.unique(key, return_counts=True)
    row, col = key // DIMS, key % DIMS
    v = np.sqrt(n.astype(np.float64))
    v[col == BIAS] = 0
    norm = np.sqrt(np.bincount(row, v * v, minlength=n_rows))
    v /= np.maximum(norm, 1e-9)[row]
    v[col == BIAS] = 1.0
    return col, v, np.concatenate(([0], np.cumsum(np.bincount(row, minlength=n_rows))))


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    base: float | None = None  # the score of every text, if only one class was seen


def learn(rows: DataFrame, shard_rows: int = 2500) -> Model:
    """rows: id, y, text, a bounded sample (``samples.labelled``), fitted in
    shards of about ``shard_rows``; small samples are passed over more often."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j in slices(b.column("text")):
                part = b.slice(i, j - i)
                col, v, off = features(*text_buffer(part.column("text")))
                lists = [pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(x, t))
                         for x, t in ((col, pa.int32()), (v, pa.float32()))]
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("y"), *lists], names=["id", "y", "index", "value"])

    few = rows.select(F.col("id").cast("string").alias("id"), "y", "text").mapInArrow(
        extract, "id string, y int, index array<int>, value array<float>").persist()
    try:
        counts = {r["y"]: r["n"] for r in few.groupBy("y").agg(F.count("*").alias("n")).collect()}
        if len(counts) < 2:
            return Model(np.zeros(DIMS, np.float32), (counts.get(1, 0) + 1) / (sum(counts.values()) + 2))
        n = sum(counts.values())
        return Model(ftrl.fit(few, DIMS, max(1, n // shard_rows), epochs=min(20, max(4, 8000 // n))))
    finally:
        few.unpersist()


def predict(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows with ``score`` (0 to 1) and ``predicted``."""
    weights = docs.sparkSession.sparkContext.broadcast(model.weights)

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        out = []
        for i, j in slices(texts):
            col, v, off = features(*text_buffer(texts.slice(i, j - i)))
            s = np.add.reduceat(weights.value[col] * v, off[:-1])
            out.append(1 / (1 + np.exp(-np.clip(s, -35, 35))))
        return pa.array(np.concatenate(out) if out else np.zeros(0))

    s = score(F.col(text_col)) if model.base is None else F.lit(model.base)
    return docs.withColumn("score", s).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
