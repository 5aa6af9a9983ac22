"""Spelling variant grouping with reduced alphabets.

1. ``word_counts``: the runs of letters of all texts, lower-cased (A-Z) and
   counted; the counts are combined before the shuffle.
2. ``reduced``: every letter of a word is hashed to one of ``symbols`` symbols;
   a reduced word is known by a polynomial hash of its symbols.
3. ``neighbourhoods``: for each DISTINCT reduced word, the hashes of all reduced
   words one edit away (every deletion, replacement and insertion), each from
   the hashes of the parts before and after the edit.  Words one edit apart
   have reduced words at most one edit apart, so joining the neighbourhoods
   with the reduced vocabulary misses no pair.
4. ``near_pairs``: the words of two such reduced words are compared as they are:
   exactly one inserted, deleted or replaced code point.
5. ``forms``: a word's form is its near word of largest count, if that is
   ``factor`` times its own; the root follows forms to the last, by doubling.

A reduced word's neighbourhood has about 2 * symbols * length hashes, whatever
the vocabulary; they are made in pieces of bounded size.  Pairs of reduced
words are taken once, in one direction; the pairs of words that come of them
are compared by executors and counted with partial aggregates.

Defined cases: null and empty texts and texts without letters have no runs; a
row with a null id counts with an empty id; repeated rows count each; ties of
the largest count go to the smallest word in code-point order; a word without
near words has n_near 0 and is its own root; very long words are words like
others; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from souk.llm.common import Scratch, ascii_lower, few, mix, trimmed

LETTERS = r"[A-Za-zÀ-ÿ]+"
#: Base of the polynomial hash, odd, and its inverse modulo 2^64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
#: Hashes that one Arrow batch of neighbours holds.
PIECE = 1 << 16


def word_counts(docs: DataFrame, min_length: int = 6, min_count: int = 5, slip: Column | None = None,
                id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) of the words of at least ``min_length`` code points that occur at
    least ``min_count`` times.  slip: the code point (from 0) that a run loses, or
    null, as an expression over ``id`` (text) and ``run``."""
    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"),
                       F.explode_outer(F.regexp_extract_all(F.col(text_col), F.lit(LETTERS), F.lit(0))).alias("run"))
    runs = rows.filter(F.col("run").isNotNull()).select("id", ascii_lower(F.col("run")).alias("run"))
    if slip is not None:
        cut = F.concat(F.substring("run", F.lit(1), F.col("at")), F.substring("run", F.col("at") + 2, F.length("run")))
        runs = runs.withColumn("at", slip.cast("int")).select(F.when(F.col("at").isNull(), F.col("run")).otherwise(cut).alias("run"))
    counts = runs.filter(F.length("run") >= min_length).groupBy(F.col("run").alias("word")).agg(F.count("*").alias("n"))
    return counts.filter(F.col("n") >= min_count)


def every_nth_run_slips(n: int) -> Column:
    """One run in about ``n``, chosen by crc32 of ``<id>:<run>``, loses the code point of that number."""
    h = F.crc32(F.concat_ws(":", "id", "run").cast("binary"))
    return F.when(h % n == 0, h % F.length("run"))


def symbols_of(text: str, symbols: int) -> np.ndarray:
    """The symbol (from 1) of each code point."""
    points = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.uint64)
    return mix((points + np.uint64(1)) * np.uint64(BASE)) % np.uint64(symbols) + np.uint64(1)


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def _parts(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes (sum of a[i] * BASE^i from each part's own start) of the first i
    symbols and of those from the i-th on, for i = 0 .. n, and the powers."""
    n = len(a)
    power = _powers(n + 2, BASE)
    before = np.concatenate(([np.uint64(0)], np.cumsum(a * power[:n])))
    after = (before[-1] - before) * _powers(n + 1, INVERSE)
    return before, after, power


def _digest(value: np.ndarray, length: int) -> np.ndarray:
    return mix(value ^ np.uint64(length * 0xD1B54A32D192ED03 & 0xFFFFFFFFFFFFFFFF)).view(np.int64)


def reduced_hash(a: np.ndarray) -> int:
    return int(_digest(_parts(a)[0][-1:], len(a))[0])


def neighbours(a: np.ndarray, symbols: int) -> Iterator[np.ndarray]:
    """Hashes of the reduced word itself and of all one edit away, in pieces, each piece distinct."""
    before, after, power = _parts(a)
    n = len(a)
    every = np.arange(1, symbols + 1, dtype=np.uint64)[None, :]
    step = max(1, PIECE // symbols)
    for i in range(0, n + 1, step):
        at = np.arange(i, min(i + step, n + 1))
        inner = at[at < n]
        less = before[inner] + after[inner + 1] * power[inner]
        same = (before[inner] + after[inner + 1] * power[inner + 1])[:, None] + every * power[inner][:, None]
        more = (before[at] + after[at] * power[at + 1])[:, None] + every * power[at][:, None]
        yield np.unique(np.concatenate((_digest(less, n - 1), _digest(same.ravel(), n), _digest(more.ravel(), n + 1))))


def reduced(words: DataFrame, symbols: int) -> DataFrame:
    """words: (word, n).  Adds ``r``, the hash of the reduced word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            r = [reduced_hash(symbols_of(w, symbols)) for w in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(r, pa.int64())], names=["word", "n", "r"])

    return words.select("word", "n").mapInArrow(trimmed(run), "word string, n long, r long")


def neighbourhoods(one_each: DataFrame, symbols: int) -> DataFrame:
    """one_each: (r, word), one word of each reduced word.  (r, near): hashes not under ``r``
    (a pair is met from its smaller side), its own included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own, near, held = [], [], 0
            for r, word in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for x in neighbours(symbols_of(word, symbols), symbols):
                    x = x[x >= r]
                    own.append(np.full(len(x), r, np.int64))
                    near.append(x)
                    held += len(x)
                    if held >= PIECE:
                        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(own)), pa.array(np.concatenate(near))], names=["r", "near"])
                        own, near, held = [], [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(own)), pa.array(np.concatenate(near))], names=["r", "near"])

    return one_each.select("r", "word").mapInArrow(trimmed(run), "r long, near long")


def near_pairs(words: DataFrame, symbols: int, scratch: Scratch) -> DataFrame:
    """words: (word, n).  (word, n, other, m): every word with each word one edit away, in both directions."""
    vocab = scratch.keep(reduced(words, symbols), "vocabulary")
    one_each = scratch.keep(vocab.groupBy("r").agg(F.min("word").alias("word")), "reduced-words")
    known = few(one_each.select(F.col("r").alias("near")))
    # pieces of one neighbourhood may repeat a hash: an edit inside a run of one symbol gives the same word
    met = scratch.keep(neighbourhoods(one_each, symbols).join(known, "near", "left_semi").distinct(), "reduced-pairs")
    left = vocab.select("r", F.col("word").alias("a"), F.col("n").alias("na"))
    right = vocab.select(F.col("r").alias("near"), F.col("word").alias("b"), F.col("n").alias("nb"))
    both = met.join(left, "r").join(right, "near").filter((F.col("r") != F.col("near")) | (F.col("a") < F.col("b")))
    true = both.filter(F.expr("levenshtein(a, b, 1) = 1")).select("a", "na", "b", "nb")
    way = F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("na").alias("n"), F.col("b").alias("other"), F.col("nb").alias("m")),
                            F.struct(F.col("b").alias("word"), F.col("nb").alias("n"), F.col("a").alias("other"), F.col("na").alias("m"))))
    return true.select(way.alias("x")).select("x.*")


def roots(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """forms: kept (word, form), without cycles.  (word, root), by doubling: each round
    follows as many forms as all rounds before, so a chain of n takes log2(n) rounds."""
    up = forms.select("word", F.col("form").alias("root"))
    while True:
        on = up.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = scratch.keep(up.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        up = step.select("word", "root")
        if step.filter("moved").isEmpty():
            return up


def groups(spark: SparkSession, words: DataFrame, factor: int = 5, symbols: int = 8) -> DataFrame:
    """words: (word, n).  One row per word: word, n, n_near, form, form_n, root."""
    scratch = Scratch(spark, "spelling")
    words = scratch.keep(words.select("word", F.col("n").cast("long").alias("n")), "words")
    pairs = near_pairs(words, symbols, scratch)
    best = F.min(F.struct((-F.col("m")).alias("m"), F.col("other").alias("other")))
    near = pairs.groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    near = scratch.keep(near.select("word", "n_near", F.col("best.other").alias("other"), (-F.col("best.m")).alias("m")), "near")
    rows = words.join(near, "word", "left")
    strong = F.col("m") >= factor * F.col("n")
    rows = rows.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(strong, F.col("other")).alias("form"),
                       F.when(strong, F.col("m")).alias("form_n"))
    rows = scratch.keep(rows, "forms")
    last = roots(rows.filter("form is not null").select("word", "form"), scratch)
    return rows.join(last, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
