"""Exact deduplication as stateful streaming jobs.

1. ``fingerprints``: rows become (id, digest, n_bytes), where the digest is the
   SHA-256 of the normalised text (A-Z lower-cased, null as empty).  A folder
   of documents is read as a file stream and written by an append-only file
   sink; a DataFrame is written once.  A row of the fingerprint table is found
   again by its locator (file name and row number).
2. ``group_stream``: a file stream over the fingerprint table keeps one state
   row per digest in RocksDB, without expiry: number of rows, and the largest
   id with its locator.  Changed groups go to one folder per micro-batch.  A
   replayed batch overwrites its folder, a restart goes on from the state.
3. ``dedup``: hits (groups of two rows or more) are read again and grouped by
   digest AND full text, so equal digests of different texts are told apart;
   such groups are split by text.

Defined cases: null text counts as empty; a null id is smaller than any other;
of rows with the same id and the same text the one with the largest locator
stays; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from souk.llm.common import Scratch, ascii_lower, few

#: Hits (an id and a digest each) that may be broadcast; more are joined by shuffle.
HITS = 200_000
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: State on disk, uploaded as changes; many small stores must not preallocate files.
STATE_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def sha256_of(col):
    """Lower-case hex SHA-256 of the normalised text."""

    @F.pandas_udf(T.StringType())
    def digest(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: hashlib.sha256((x or "").encode("utf-8", "surrogatepass").translate(_LOWER)).hexdigest())

    return digest(col)


def fingerprints(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text",
                 digest=sha256_of) -> DataFrame:
    """The fingerprint table of a batch or streaming DataFrame."""
    rows = docs.select(F.col(id_col).alias("id"), digest(F.col(text_col)).alias("digest"),
                       F.coalesce(F.octet_length(text_col), F.lit(0)).alias("n_bytes"))
    path = scratch.folder("fingerprints")
    if docs.isStreaming:
        (rows.writeStream.format("parquet").option("checkpointLocation", scratch.folder("fingerprints-log"))
         .trigger(availableNow=True).start(path).awaitTermination())
    else:
        rows.write.parquet(path)
    out = docs.sparkSession.read.schema(rows.schema).parquet(path)
    out._scratch_path = path
    return out


def _located(fp: DataFrame) -> DataFrame:
    return fp.select("id", "digest", "n_bytes",
                     F.struct(F.col("_metadata.file_name").alias("file"),
                              F.col("_metadata.row_index").alias("row")).alias("locator"))


def group_stream(spark: SparkSession, path: str, schema: T.StructType, scratch: Scratch,
                 max_files_per_trigger: int = 10_000, state: str | None = None) -> DataFrame:
    """Run the stateful grouping over every file of ``path`` not seen yet and
    return the groups (digest, n, top = (id, locator)).  Give ``state`` (a
    folder) to go on from an earlier run's state."""
    state = state or scratch.folder("groups")
    stream = (spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger).parquet(path))
    groups = (_located(stream).groupBy("digest")
              .agg(F.count("*").alias("n"), F.max(F.struct("id", "locator")).alias("top")))

    def write_epoch(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{state}/changed/epoch={epoch}")

    before = {key: spark.conf.get(key, None) for key in STATE_SETTINGS}
    for key, value in STATE_SETTINGS.items():
        spark.conf.set(key, value)
    try:
        (groups.writeStream.outputMode("update").option("checkpointLocation", f"{state}/log")
         .foreachBatch(write_epoch).trigger(availableNow=True).start().awaitTermination())
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    changed = spark.read.schema(groups.schema).parquet(f"{state}/changed")
    # n and top only grow, so a group's newest version is its largest
    return changed.groupBy("digest").agg(F.max("n").alias("n"), F.max("top").alias("top"))


def _check_bytes(docs: DataFrame, rows: DataFrame, groups: DataFrame, scratch: Scratch,
                 id_col: str, text_col: str) -> DataFrame:
    """(digest, text key) classes of the rows that share a digest, from their full texts."""
    hits = few(scratch.keep(rows.join(groups.filter("n > 1").select("digest"), "digest").select("id", "digest").distinct(), "hits"), HITS)
    texts = docs.select(F.col(id_col).alias("doc"), F.coalesce(ascii_lower(F.col(text_col)), F.lit("")).alias("body"))
    return texts.join(hits, F.col("doc").eqNullSafe(F.col("id")))


def dedup(spark: SparkSession, docs: DataFrame, stream: DataFrame | None = None, id_col: str = "doc_id",
          text_col: str = "text", digest=sha256_of, max_files_per_trigger: int = 10_000) -> DataFrame:
    """One row per row of ``docs``: id, digest, n_bytes, locator, keep_id,
    group_size, kept.  ``stream`` is the same table as a streaming DataFrame;
    without it the fingerprints are taken from ``docs``."""
    scratch = Scratch(spark, "exact")
    fp = fingerprints(stream if stream is not None else docs, scratch, id_col, text_col, digest)
    groups = scratch.keep(group_stream(spark, fp._scratch_path, fp.schema, scratch, max_files_per_trigger), "top")
    rows = _located(fp)
    found = _check_bytes(docs, rows, groups, scratch, id_col, text_col)
    # an id may have other texts, too, and a null id is any of several rows'
    found = found.filter(digest(F.col("body")) == F.col("digest"))
    classes = scratch.keep(found.groupBy("digest", "body").agg(F.count("*").alias("n")).groupBy("digest")
                           .agg(F.count("*").alias("texts")).filter("texts > 1"), "collisions")
    out = rows.join(groups, "digest", "left")
    if classes.isEmpty():
        return out.select("id", "digest", "n_bytes", "locator", F.col("top.id").alias("keep_id"),
                          F.col("n").alias("group_size"),
                          (F.col("id").eqNullSafe(F.col("top.id")) & (F.col("locator") == F.col("top.locator"))).alias("kept"))
    return _split_collisions(out, rows, found, classes)


def _split_collisions(out: DataFrame, rows: DataFrame, found: DataFrame, classes: DataFrame) -> DataFrame:
    """Groups of different texts under one digest, split by their texts."""
    bodies = found.join(classes.select("digest"), "digest").select("id", "digest", "body").distinct()
    r = rows.join(classes.select("digest"), "digest")
    b = r.join(bodies, (r["digest"] == bodies["digest"]) & r["id"].eqNullSafe(bodies["id"])).select(
        r["id"], r["digest"], "n_bytes", "locator", "body")
    per = b.groupBy("digest", "body").agg(F.count("*").alias("n"), F.max(F.struct("id", "locator")).alias("top"))
    split = b.join(per, ["digest", "body"])
    clean = out.join(classes.select("digest"), "digest", "left_anti")
    cols = ["id", "digest", "n_bytes", "locator", F.col("top.id").alias("keep_id"), F.col("n").alias("group_size"),
            (F.col("id").eqNullSafe(F.col("top.id")) & (F.col("locator") == F.col("top.locator"))).alias("kept")]
    return clean.select(*cols).unionByName(split.select(*cols))


def keep_rows(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    scratch = Scratch(spark, "exact-rows")
    marks = scratch.keep(dedup(spark, docs, id_col=id_col, text_col=text_col).select("id", "digest", "kept"), "marks")
    lost = marks.filter(~F.col("kept")).select("id", "digest")
    kept = marks.filter("kept").select("id", "digest")
    # an id that has rows on both sides (repeated rows, or texts of two groups) is settled by its texts
    mixed = scratch.keep(kept.join(lost, kept["id"].eqNullSafe(lost["id"]), "left_semi").select("id", "digest"), "mixed")
    gone = few(scratch.keep(lost.select("id").distinct(), "gone"))
    plain = docs.join(gone, docs[id_col].eqNullSafe(gone["id"]), "left_anti")
    if mixed.isEmpty():
        return plain
    keys = mixed.select("id").distinct()
    cand = docs.join(keys, docs[id_col].eqNullSafe(keys["id"]), "left_semi").withColumn("__digest", sha256_of(F.col(text_col)))
    cand = cand.dropDuplicates([id_col, "__digest"])
    sel = cand.join(mixed, cand[id_col].eqNullSafe(mixed["id"]) & (cand["__digest"] == mixed["digest"]), "left_semi")
    return plain.unionByName(sel.drop("__digest"))
