"""Helpers for running the streaming jobs on file streams.

All streaming state, checkpoints and sinks live under the session's
``spark.checkpoint.dir`` (a shared folder on a cluster), each run in its own
fresh sub-folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from souk.session import run_folder  # noqa: F401


def stage_files(df: DataFrame, path: str, key: str | None = None) -> str:
    """Write ``df`` as the input folder of a file-source stream, rows spread by
    ``key`` over as many files as the session has shuffle partitions."""
    files = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = df.repartition(files, F.col(key)) if key else df.repartition(files)
    out.write.mode("overwrite").parquet(path)
    return path


def file_stream(spark: SparkSession, path: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    r = spark.readStream.schema(schema).format("parquet")
    if files_per_trigger:
        r = r.option("maxFilesPerTrigger", files_per_trigger)
    return r.load(path)


class EpochLog:
    """The state that a stream leaves behind, as a table of changes.

    ``write`` is a ``foreachBatch`` sink: the changes of micro-batch k go to a
    folder of their own, overwritten when the batch is run again, so each
    counts once.  ``merge`` turns any rows of the log into one row per key, and
    merging merged rows gives the same as merging all at once.  Every
    ``every`` batches the log is compacted: what there is up to k is merged
    into a base, which counts once Spark has committed it; the changes and
    bases that an older base already covers go.  So the log holds two bases
    and at most 2 * ``every`` changes, however long the stream runs, and a
    batch that is run again still finds the state before it."""

    def __init__(self, spark: SparkSession, path: str, schema, merge, every: int = 16):
        self.spark, self.path, self.schema, self.merge, self.every = spark, path, schema, merge, every

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def parts(self) -> dict[str, list[int]]:
        """The committed folders: epochs of the bases and of the changes."""
        fs, root = self._fs(self.path)
        out: dict[str, list[int]] = {"base": [], "delta": []}
        for x in fs.listStatus(root) if fs.exists(root) else []:
            kind, _, epoch = x.getPath().getName().partition("-")
            if kind in out and self._fs(f"{self.path}/{kind}-{epoch}/_SUCCESS")[0].exists(self._fs(f"{self.path}/{kind}-{epoch}/_SUCCESS")[1]):
                out[kind].append(int(epoch))
        return {k: sorted(v) for k, v in out.items()}

    def read(self, upto: int | None = None) -> DataFrame:
        """The state after micro-batch ``upto`` (after all of them if omitted)."""
        have = self.parts()
        base = max((b for b in have["base"] if upto is None or b <= upto), default=None)
        paths = [f"{self.path}/base-{base}"] if base is not None else []
        paths += [f"{self.path}/delta-{d}" for d in have["delta"] if (base is None or d > base) and (upto is None or d <= upto)]
        rows = self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)
        return self.merge(rows)

    def write(self, changes: DataFrame, epoch: int) -> None:
        self.merge(changes).write.mode("overwrite").parquet(f"{self.path}/delta-{epoch}")
        if (epoch + 1) % self.every == 0:
            self.compact(epoch)

    def compact(self, epoch: int) -> None:
        self.read(epoch).write.mode("overwrite").parquet(f"{self.path}/base-{epoch}")
        have = self.parts()
        older = [b for b in have["base"] if b < epoch]
        if older:
            gone = [f"base-{b}" for b in older[:-1]] + [f"delta-{d}" for d in have["delta"] if d <= older[-1]]
            for name in gone:
                fs, p = self._fs(f"{self.path}/{name}")
                fs.delete(p, True)
