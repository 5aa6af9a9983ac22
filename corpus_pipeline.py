"""Corpus pipeline: language ID, exact dedup, near dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
it as Parquet to the session's shared folder and rereads it as the next one's
docs.  All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from souk.llm import exact_dedup, langid, minhash, mixing, packing
from souk.llm.common import Scratch, few

#: Below this share of the smallest possible distance a text is in none of the
#: learned languages; clean prose, however short, scores 0.4 and more.
MIN_LANGUAGE_SCORE = 0.2

#: No SQL: profiles, MinHash, the hash orders of mixing and the tokenizer are not expressible.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without letters or unlike every learned language go."""
    profiles = langid.learn(docs, F.lit(True))
    out = langid.predict(docs, profiles)
    keep = (F.col("lang_pred") != langid.UND) & (F.col("score") >= MIN_LANGUAGE_SCORE)
    return out.filter(keep).select(docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest id stays."""
    return exact_dedup.keep_rows(spark, docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicates (five-word shingles, 0.8) the smallest id stays."""
    out = minhash.near_duplicates(spark, docs, k=5, percent=80)
    gone = Scratch(spark, "near").keep(out.filter(~F.col("kept")).select(F.col("id").alias("__id")).distinct(), "gone")
    return docs.join(few(gone), F.col("doc_id") == F.col("__id"), "left_anti")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.taken_rows(spark, docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a sequence of at most 2,048 tokens."""
    return packing.pack(docs).withColumnRenamed("id", "doc_id")


STAGES = [("language_id", language), ("exact_dedup", exact), ("minhash", near), ("mixing", mixed), ("packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return docs
