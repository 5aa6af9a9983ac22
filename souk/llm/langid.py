"""Language identification by rank-order n-gram profiles.

A profile is a ranking of the most frequent letter n-grams (1 to 3 letters,
word starts and ends marked).  A document's language is the one whose profile
has the smallest out-of-place distance to the document's own ranking: the sum,
over the document's n-grams, of how far each is from its place in the profile;
an n-gram that the profile lacks counts as ``profile_size``.

Profiles are learned from at most about ``max_rows`` labelled rows (a hash
sample of the eligible ones); every whole text is scored.  Ties: n-grams of
equal frequency are ranked by code point, languages of equal distance by name.
Null, empty or letterless text gives ``und`` with score 0, as does any text if
no labelled row exists.  Other columns are ignored, repeated rows are scored
each, an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from souk.llm.common import slices, trimmed
from souk.llm.samples import at_most_each

UND = "und"
_LETTERS: np.ndarray | None = None


def _letters() -> np.ndarray:
    """Per code point: 2 + its lower-case form for a letter, 1 for anything else."""
    global _LETTERS
    if _LETTERS is None:
        table = np.ones(0x110000, np.int64)
        for c in range(0x110000):
            s = chr(c)
            if s.isalpha():
                low = s.lower()
                table[c] = 2 + (ord(low) if len(low) == 1 else c)
        _LETTERS = table
    return _LETTERS


def chunk_grams(texts: list[str | None]) -> Iterator[np.ndarray]:
    """For each text, the codes of all its 1-, 2- and 3-grams, with repeats."""
    joined = "\n".join(["", *((x or "").replace("\0", " ") for x in texts), ""])
    cp = _letters()[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)]
    size = np.array([len(x or "") for x in texts], np.int64)
    begin = np.concatenate(([0], np.cumsum(size + 1)))  # of each text, at the separator before it
    keep = np.ones(len(cp), bool)
    keep[1:] = (cp[1:] != 1) | (cp[:-1] != 1)
    at = np.cumsum(keep) - 1  # place of the last kept code up to here
    c = cp[keep]
    two = (c[:-1] << 21) | c[1:]
    three = (two[:-1] << 21) | c[2:] if len(c) > 2 else np.zeros(0, np.int64)
    if len(c) > 2:
        three[c[1:-1] == 1] = 0
    for i in range(len(texts)):
        a, b = at[begin[i]], at[min(begin[i + 1], len(at) - 1)]  # from the space before to the space after
        if b - a < 2:
            yield np.zeros(0, np.int64)
            continue
        one = c[a:b]
        t = three[a:b - 1]
        yield np.concatenate((one[one != 1], two[a:b], t[t != 0]))


def ranked(grams: np.ndarray, size: int) -> np.ndarray:
    """The ``size`` most frequent codes, most frequent first."""
    codes, n = np.unique(grams, return_counts=True)
    if len(codes) > size:  # all with at least the size-th count
        least = np.partition(n, len(n) - size)[len(n) - size]
        codes, n = codes[n >= least], n[n >= least]
    return codes[np.argsort(-n, kind="stable")[:size]]


@dataclass(frozen=True)
class Profiles:
    """codes: sorted; ranks[i, j]: place of code i in the profile of language j."""

    languages: list[str]
    codes: np.ndarray
    ranks: np.ndarray
    size: int

    def distances(self, doc: np.ndarray) -> np.ndarray:
        """Out-of-place distance to each language, as a share of the largest possible."""
        if not len(self.codes):
            return np.ones(len(self.languages))
        i = np.minimum(np.searchsorted(self.codes, doc), len(self.codes) - 1)
        known = self.codes[i] == doc
        place = self.ranks[i[known]]
        away = np.abs(place - np.flatnonzero(known)[:, None])
        away = np.where(place >= self.size, self.size, np.minimum(away, self.size))
        return (away.sum(axis=0) + self.size * (len(doc) - known.sum())) / (self.size * len(doc))


def learn(docs: DataFrame, eligible: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          profile_size: int = 400, max_rows: int = 5_000) -> Profiles:
    """Profiles from a sample of the eligible rows, of about ``max_rows`` for each
    language, so that a language has a profile however rare it is.  Only the
    profiles themselves (``profile_size`` rows a language) come to the driver."""
    rows = docs.filter(eligible & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    rows = at_most_each(rows, "lang", "id", max_rows)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j in slices(b.column("text")):
                part = b.slice(i, j - i)
                by: dict[str, list[np.ndarray]] = {}
                for lang, grams in zip(part.column("lang").to_pylist(), chunk_grams(part.column("text").to_pylist()), strict=True):
                    by.setdefault(lang, []).append(grams)
                for lang, all_grams in by.items():
                    codes, n = np.unique(np.concatenate(all_grams), return_counts=True)
                    yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(codes), pa.string()), "gram": codes, "n": n.astype(np.int64)})

    counts = rows.select("lang", "text").mapInArrow(trimmed(count), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    top = counts.withColumn("place", place - 1).filter(F.col("place") < profile_size).select("lang", "gram", "place").toPandas()
    languages = sorted(top["lang"].unique())
    codes = np.unique(top["gram"].to_numpy(np.int64))
    ranks = np.full((len(codes), len(languages)), profile_size, np.int64)
    ranks[np.searchsorted(codes, top["gram"].to_numpy(np.int64)), [languages.index(x) for x in top["lang"]]] = top["place"].to_numpy(np.int64)
    return Profiles(languages, codes, ranks, profile_size)


def predict(docs: DataFrame, profiles: Profiles, text_col: str = "text", doc_grams: int = 300) -> DataFrame:
    """The rows with ``lang_pred`` and ``score``: 1 minus the winner's distance."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k = b.schema.get_field_index("__text")
            for i, j in slices(b.column(k)):
                part = b.slice(i, j - i)
                langs, scores = [], []
                for grams in chunk_grams(part.column(k).to_pylist()):
                    if not len(grams) or not profiles.languages:
                        langs.append(UND)
                        scores.append(0.0)
                        continue
                    d = profiles.distances(ranked(grams, doc_grams))
                    best = int(np.argmin(d))
                    langs.append(profiles.languages[best])
                    scores.append(float(1 - d[best]))
                cols = [c for x, c in enumerate(part.columns) if x != k]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], schema=out_arrow)

    rest = docs.drop("lang_pred", "score")
    given = rest.withColumn("__text", F.col(text_col))
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    out = T.StructType([*rest.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    out_arrow = to_arrow_schema(out)
    return given.mapInArrow(trimmed(score), out)
