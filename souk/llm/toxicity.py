"""Toxicity by a weighted lexicon, matched with Aho-Corasick.

Folding.  Texts are compared in a folded form: compatibility forms and case by
Unicode, look-alike Cyrillic and Greek letters to Latin ones, digits and signs
that stand for letters (only next to a letter), invisible characters removed,
every other non-letter a blank.

Lexicon.  Entries are whole words and word beginnings of 4 to 8 letters whose
document frequency in labelled toxic texts is far above that in clean ones
(signed likelihood ratio of at least ``MIN_G``); the weight is the smoothed
log ratio.  Exception phrases are two-word phrases around a matched word that
clean texts hold and toxic ones never do, next to ``EXCEPTIONS``.

Score.  Each word counts once, with its heaviest entry, unless an exception
phrase covers it.  The sum of weights, the sum over the square root of the
number of words, and the sum per hundred words are the inputs of a logistic
calibration, fitted on the half of the labelled sample the lexicon did not use.

Defined cases: null, empty and letterless texts match nothing and have the
calibration's base score; without labelled rows of both classes the lexicon is
empty and every score is the smoothed share of toxic labels; other columns are
ignored, repeated rows are scored each, an empty table gives no rows.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from souk.llm.common import slices

#: Letters that look like Latin ones.
LOOKALIKES = dict(zip("аеорсухіјѕԁһӏкмтнгαεικνορτυχγω", "aeopcyxijsdhlkmthraeikvoptuxyw", strict=True))
#: Digits and signs that stand for a letter next to one.
STAND_INS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s"}
INVISIBLE = "­​‌‍⁠﻿"
#: Phrases in which a common insult is none.
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "clown fish", "circus clown", "class clown", "pathetic fallacy",
              "sore loser", "pond scum", "scum line")
MIN_G, MIN_SUPPORT, PREFIX = 25.0, 5, (4, 8)

_BLANK, _GONE = 32, 0xFFFF_FFFF
_TABLES: tuple[np.ndarray, np.ndarray] | None = None


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Per code point: its folded letter (or blank, or gone), and the letter it may stand for (or 0)."""
    global _TABLES
    if _TABLES is None:
        fold = np.full(0x110000, _BLANK, np.uint32)
        stands = np.zeros(0x110000, np.uint32)
        for c in range(0x110000):
            s = chr(c)
            if s.isalpha() or not s.isascii():
                low = unicodedata.normalize("NFKC", s).lower()
                low = LOOKALIKES.get(low, low)
                if len(low) == 1 and low.isalpha():
                    fold[c] = ord(low)
                elif low in STAND_INS:
                    stands[c] = ord(STAND_INS[low])
                elif s.isalpha():
                    fold[c] = c
        for s, letter in STAND_INS.items():
            stands[ord(s)] = ord(letter)
        for s in INVISIBLE:
            fold[ord(s)] = _GONE
        _TABLES = fold, stands
    return _TABLES


def folded(text: str | None) -> str:
    """Letters and single blanks, with a blank at both ends."""
    if not text:
        return " "
    fold, stands = _tables()
    cp = np.frombuffer(f" {text} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    f = fold[cp]
    if (f == _GONE).any():
        cp, f = cp[f != _GONE], f[f != _GONE]
    s = stands[cp]
    if s.any():
        letter = f != _BLANK
        may = letter | (s != 0)
        beside = letter.copy()
        beside[1:] |= letter[:-1]
        beside[:-1] |= letter[1:]
        # a run of stand-ins counts if one of its ends is next to a letter
        turn = may & beside
        for _ in range(2):
            turn[1:] |= turn[:-1] & (s[1:] != 0)
            turn[:-1] |= turn[1:] & (s[:-1] != 0)
        f = np.where((s != 0) & turn, s, f)
    blank = f == _BLANK
    keep = np.ones(len(f), bool)
    keep[1:] = ~(blank[1:] & blank[:-1])
    return f[keep].tobytes().decode("utf-32-le", "surrogatepass")


def candidates(text: str) -> set[str]:
    """The lexicon entries that a folded text could give: ' word ' and ' beginning'."""
    out = set()
    for w in set(text.split()):
        out.add(f" {w} ")
        out.update(f" {w[:k]}" for k in range(PREFIX[0], min(PREFIX[1], len(w)) + 1))
    return out


@dataclass(frozen=True)
class Model:
    lexicon: dict[str, float]
    exceptions: tuple[str, ...] = EXCEPTIONS
    coef: tuple[float, ...] = field(default=())
    base: float = 0.5

    def automaton(self) -> ahocorasick.Automaton:
        a = ahocorasick.Automaton()
        entries: dict[str, tuple[float | None, int]] = {k: (w, len(k)) for k, w in self.lexicon.items()}
        entries |= {f" {p} ": (None, len(p) + 2) for p in self.exceptions}
        for k, v in entries.items():
            a.add_word(k, v)
        if entries:
            a.make_automaton()
        return a


_AUTOMATA: dict[int, ahocorasick.Automaton] = {}


def _automaton(model: Model) -> ahocorasick.Automaton:
    """Built once per worker for a model."""
    key = hash((tuple(sorted(model.lexicon.items())), model.exceptions))
    if key not in _AUTOMATA:
        _AUTOMATA.clear()
        _AUTOMATA[key] = model.automaton()
    return _AUTOMATA[key]


def matches(text: str, automaton: ahocorasick.Automaton) -> dict[int, float]:
    """Start of each matched word in a folded text -> weight, without those in exception phrases."""
    if not len(automaton):
        return {}
    found: dict[int, float] = {}
    exempt: list[tuple[int, int]] = []
    for end, (weight, size) in automaton.iter(text):
        start = end - size + 1
        if weight is None:
            exempt.append((start, end))
        else:
            found[start] = max(weight, found.get(start, 0.0))
    for a, b in exempt:
        for start in [s for s in found if a <= s < b]:
            del found[start]
    return found


def inputs(text: str, automaton: ahocorasick.Automaton) -> tuple[float, ...]:
    found = matches(text, automaton)
    total, words = sum(found.values()), max(1, text.count(" ") - 1)
    return (np.log1p(total), np.log1p(total / words ** 0.5), np.log1p(100 * total / words), float(len(found) > 0))


def calibrate(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the last coefficient is the bias."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, penalty = np.zeros(x.shape[1]), np.diag([ridge] * (x.shape[1] - 1) + [1e-6])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + penalty, x.T @ (p - y) + penalty @ w)
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    return w


def learn(rows: DataFrame, max_entries: int = 2000, max_exceptions: int = 500) -> Model:
    """rows: id, y, text, a bounded sample (``samples.labelled``)."""
    half = F.pmod(F.xxhash64(F.col("id").cast("string"), F.lit(3)), F.lit(2))
    rows = rows.select("y", "text", half.alias("half")).persist()
    try:
        return _learn(rows, max_entries, max_exceptions)
    finally:
        rows.unpersist()


def _learn(rows: DataFrame, max_entries: int, max_exceptions: int) -> Model:
    size = {(r["half"], r["y"]): r["n"] for r in rows.groupBy("half", "y").agg(F.count("*").alias("n")).collect()}
    n1, n0 = size.get((0, 1), 0), size.get((0, 0), 0)
    base = (sum(n for (_, y), n in size.items() if y) + 1) / (sum(size.values()) + 2)
    if not (n1 and n0):
        return Model({}, (), (), base)

    def counted(take, schema: str):
        """Documents per string and label, summed inside each task before the shuffle."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                count: dict[int, Counter] = {0: Counter(), 1: Counter()}
                for y, text in zip(b.column("y").to_pylist(), b.column("text").to_pylist(), strict=True):
                    count[y].update(take(folded(text)))
                for y, c in count.items():
                    yield pa.RecordBatch.from_pydict({"s": pa.array(list(c), pa.string()), "y": pa.array([y] * len(c), pa.int32()),
                                                      "n": pa.array(list(c.values()), pa.int64())})

        got = rows.filter("half = 0").select("y", "text").mapInArrow(run, schema)
        return got.groupBy("s").agg(F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("k1"),
                                    F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("k0"))

    df = counted(candidates, "s string, y int, n long")
    k, share = F.col("k1") + F.col("k0"), n1 / (n1 + n0)
    part = lambda x, e: F.when(x > 0, x * F.log(x / e)).otherwise(0.0)
    g = 2 * (part(F.col("k1"), k * share) + part(F.col("k0"), k * (1 - share)))
    weight = F.log((F.col("k1") + 0.5) / (n1 + 1)) - F.log((F.col("k0") + 0.5) / (n0 + 1))
    top = (df.filter((F.col("k1") >= MIN_SUPPORT) & (F.col("k1") * n0 > 4 * F.col("k0") * n1) & (g >= MIN_G))
           .select("s", weight.alias("w")).orderBy(F.desc("w"), "s").limit(max_entries).collect())
    lexicon = {r["s"]: float(r["w"]) for r in top}
    first = Model(lexicon)

    def phrases(text: str) -> set[str]:
        out = set()
        for start in matches(text, _automaton(first)):
            stop = text.index(" ", start + 1)
            after = text.find(" ", stop + 1)
            if after > 0:
                out.add(text[start + 1: after])
            before = text.rfind(" ", 0, start) if start > 0 else -1
            if before >= 0:
                out.add(text[before + 1: stop])
        return out

    said = (counted(phrases, "s string, y int, n long").filter("k0 >= 3 and k1 = 0 and s like '% %'")
            .orderBy(F.desc("k0"), "s").limit(max_exceptions).collect())
    model = Model(lexicon, tuple(dict.fromkeys([*EXCEPTIONS, *(r["s"] for r in said)])))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        a = _automaton(model)
        x = np.array([inputs(folded(t), a) for t in pdf["text"]])
        return pd.DataFrame({"coef": [calibrate(x, pdf["y"].to_numpy(float)).tolist()]})

    other = rows.filter("half = 1") if size.get((1, 1), 0) and size.get((1, 0), 0) else rows
    coef = other.groupBy(F.lit("fit")).applyInPandas(fit, "coef array<double>").collect()[0]["coef"]
    return Model(model.lexicon, model.exceptions, tuple(coef), base)


def predict(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows with ``score`` (0 to 1), ``predicted`` and ``terms``, the number of matched words."""

    @F.arrow_udf("struct<score: double, terms: int>")
    def score(texts: pa.Array) -> pa.Array:
        a, scores, terms = _automaton(model), [], []
        for i, j in slices(texts):
            for text in texts.slice(i, j - i).to_pylist():
                f = folded(text)
                found = matches(f, a)
                if model.coef:
                    s = float(np.dot(model.coef[:-1], inputs(f, a)) + model.coef[-1]) if found else model.coef[-1]
                    scores.append(1 / (1 + np.exp(-np.clip(s, -35, 35))))
                else:
                    scores.append(model.base)
                terms.append(len(found))
        return pa.StructArray.from_arrays([pa.array(scores, pa.float64()), pa.array(terms, pa.int32())], ["score", "terms"])

    return (docs.withColumn("__toxicity", score(F.col(text_col)))
            .withColumn("score", F.col("__toxicity.score")).withColumn("terms", F.col("__toxicity.terms"))
            .drop("__toxicity").withColumn("predicted", (F.col("score") >= threshold).cast("int")))
