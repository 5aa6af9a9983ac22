"""Helpers shared by the training-data operators: staged tables in the shared
folder and vectorised hashing of words in Arrow batches."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from souk.session import checkpoint_dir

#: Text bytes handled at once inside a task, whatever the size of an Arrow batch:
#: the arrays made from them take some fifty times as much.
CHUNK_BYTES = 1 << 19


class Scratch:
    """A folder of one run under the session's shared checkpoint folder.

    ``keep`` writes a table there and reads it back: the plan after it starts
    from files that outlive any executor.  ``drop`` deletes one such table
    once nothing reads it any more; the rest stays until the folder's owner
    clears it, since returned DataFrames read from it.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{checkpoint_dir(spark).rstrip('/')}/souk-llm/{name}-{uuid.uuid4().hex[:12]}"
        self._n = 0

    def folder(self, name: str) -> str:
        self._n += 1
        return f"{self.path}/{self._n:03d}-{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = self.folder(name)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        path = getattr(df, "_scratch_path", None)
        if path:
            jvm = self.spark._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


#: Rows of a table of a few numbers each that may be broadcast (some 40 MB).
FEW_ROWS = 1_000_000


def few(df: DataFrame, limit: int = FEW_ROWS) -> DataFrame:
    """A kept table of a few numbers a row, marked for broadcast if its counted
    rows are within the bound; beyond it, it is joined by shuffle."""
    return F.broadcast(df) if df.count() <= limit else df


def ascii_lower(col):
    """Lower-cases A-Z only."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def crc_mod(col, n: int):
    """crc32 of an id as text, modulo n: the contracts' held-out rule."""
    return F.crc32(col.cast("string").cast("binary")) % F.lit(n)


def text_buffer(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and n + 1 offsets; nulls have length 0."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    arr = arr.cast(pa.large_string()).fill_null("")
    bufs = arr.buffers()
    offsets = np.frombuffer(bufs[1], dtype=np.int64)[arr.offset: arr.offset + len(arr) + 1]
    data = np.frombuffer(bufs[2], dtype=np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0]: offsets[-1]] if len(arr) else data[:0], offsets - offsets[0]


def slices(arr: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of a string column with at most ``limit`` bytes (or one row) each."""
    _, off = text_buffer(arr)
    i = 0
    while i < len(off) - 1:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, side="right")) - 1)
        yield i, j
        i = j


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POS = 1024
_TABLE: np.ndarray | None = None


def _byte_table() -> np.ndarray:
    """A random 64-bit value for each (position in word, byte), the same in every process."""
    global _TABLE
    if _TABLE is None:
        i = np.arange(_POS * 256, dtype=np.uint64) + np.uint64(1)
        _TABLE = mix(mix(i * np.uint64(0x9E3779B97F4A7C15)) + np.uint64(0x2545F4914F6CDD1D))
    return _TABLE


def hash_words(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of the maximal runs of ``is_word`` bytes inside each row
    (tabulation hashing over byte and position), the row of each run, and the
    byte position where each starts."""
    if not len(data):
        z = np.zeros(0, np.uint64)
        return z, np.zeros(0, np.int64), np.zeros(0, np.int64)
    begins = is_word.copy()
    begins[1:] &= ~is_word[:-1]
    first = offsets[:-1][offsets[:-1] < offsets[1:]]
    begins[first] |= is_word[first]
    starts = np.flatnonzero(begins)
    if not len(starts):
        z = np.zeros(0, np.uint64)
        return z, np.zeros(0, np.int64), np.zeros(0, np.int64)
    seg = np.diff(np.append(starts, len(data)))
    pos = np.arange(starts[0], len(data)) - np.repeat(starts, seg)
    byte = data[starts[0]:].astype(np.int64)
    part = _byte_table()[((pos & (_POS - 1)) << 8) | byte]
    if seg.max() > _POS:
        part = part * (((pos >> 10).astype(np.uint64) << np.uint64(1)) | np.uint64(1))
    part[~is_word[starts[0]:]] = 0
    h = mix(np.add.reduceat(part, starts - starts[0]))
    rows = np.searchsorted(offsets, starts, side="right") - 1
    return h, rows, starts


def lowered(data: np.ndarray) -> np.ndarray:
    up = (data >= 65) & (data <= 90)
    return data + (up.astype(np.uint8) << 5)


def not_space(data: np.ndarray) -> np.ndarray:
    """Bytes of words ``[^\\x20\\x09-\\x0D]+``."""
    return ~((data == 32) | ((data >= 9) & (data <= 13)))


def shingles(h: np.ndarray, rows: np.ndarray, n_rows: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-word shingle hashes, sorted within each row, and n_rows + 1
    offsets.  A row with 1..k-1 words has one shingle, its whole sequence."""
    if not len(h):
        return np.zeros(0, np.uint64), np.zeros(n_rows + 1, np.int64)
    counts = np.bincount(rows, minlength=n_rows)
    ends = np.cumsum(counts)
    salt = np.uint64(0x9E3779B97F4A7C15)
    left = ends[rows] - np.arange(len(h))  # words from here to the row's end
    x = np.full(len(h), k, np.uint64) * salt
    for j in range(k):
        at = np.minimum(np.arange(len(h)) + j, len(h) - 1)
        inside = left > j
        x = np.where(inside, mix((x ^ h[at]) * salt + np.uint64(j + 1)), x)
    size = np.minimum(left, k).astype(np.uint64)
    x = mix(x + size)
    whole = (counts[rows] < k) & (left == counts[rows])
    keep = (left >= k) | whole
    x, r = x[keep], rows[keep]
    order = np.lexsort((x, r))
    x, r = x[order], r[order]
    new = np.ones(len(x), bool)
    new[1:] = (x[1:] != x[:-1]) | (r[1:] != r[:-1])
    x, r = x[new], r[new]
    return x, np.concatenate(([0], np.cumsum(np.bincount(r, minlength=n_rows))))


def trimmed(run):
    """A mapInArrow function that gives freed memory back to the system at the
    end of a task: Python workers live on, beside the executor's heap."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # only where the C library can
                ctypes.CDLL(None).malloc_trim(0)

    return wrapped
