"""Bounded samples of labelled rows for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from souk.llm.common import few


def at_most(rows: DataFrame, id_col: str, bound: int, seed: int = 7) -> DataFrame:
    """All rows if there are at most ``bound``; else those whose id hashes into
    a share of ``bound / count`` (about ``bound`` rows, the same at every run)."""
    n = rows.count()
    if n <= bound:
        return rows
    share = int(bound / n * (1 << 32))
    return rows.filter((F.xxhash64(F.col(id_col).cast("string"), F.lit(seed)).bitwiseAND(F.lit(0xFFFFFFFF))) < F.lit(share))


def at_most_each(rows: DataFrame, group: str, id_col: str, bound: int, seed: int = 7) -> DataFrame:
    """Of each group, all rows if there are at most ``bound``, else those whose id
    hashes into a share of ``bound / count``, the same at every run.

    The shares, a row per group, are broadcast if they are few by their count."""
    shares = rows.groupBy(group).agg(F.least(F.lit(1.0), F.lit(float(bound)) / F.count("*")).alias("__share"))
    at = F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(seed)).bitwiseAND(F.lit(0xFFFFFFFF))
    return rows.join(few(shares), group).filter(at < F.col("__share") * F.lit(float(1 << 32))).drop("__share")


def labelled(docs: DataFrame, labels: DataFrame, label: str, eligible, max_positive: int, max_negative: int,
             id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, y, text) of at most about ``max_positive`` + ``max_negative`` labelled rows.

    The narrow labels are sampled before they meet the texts, so the side that
    may be broadcast has a proven bound.  Rows without a label, an id or a text
    are left out; an id with several labels counts as 1 if any is 1.
    """
    y = (labels.filter(eligible & F.col(label).isin(0, 1) & F.col(id_col).isNotNull())
         .groupBy(F.col(id_col).alias("id")).agg(F.max(label).cast("int").alias("y")))
    few = at_most(y.filter("y = 1"), "id", max_positive).unionByName(at_most(y.filter("y = 0"), "id", max_negative))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("text is not null")
    return texts.join(F.broadcast(few), "id").select("id", "y", "text")
