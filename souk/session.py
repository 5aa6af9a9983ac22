"""Spark session settings used by tests, the bench and the examples."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app: str = "souk") -> SparkSession:
    cpus = os.environ.get("BENCH_CPUS", "8")
    master = master or f"local[{cpus}]"
    parts = shuffle_partitions or int(cpus) * 2
    spark = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("SOUK_DRIVER_MEMORY", "16g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints, staged tables and stream state.

    ``spark.checkpoint.dir`` names it; a directory the caller has set with
    ``SparkContext.setCheckpointDir`` is kept.  Without either there is no
    folder that the driver and all executors are known to share, so this
    fails instead of falling back to a machine-local path.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    current = sc.getCheckpointDir()
    if not named and not current:
        raise RuntimeError("set spark.checkpoint.dir (or call SparkContext.setCheckpointDir) to a folder "
                           "that the driver and all executors share")
    if not current:
        sc.setCheckpointDir(named)
    return named or current


def run_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder for one run under the checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/souk-{name}-{uuid.uuid4().hex[:12]}"


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A session setting that holds inside the block."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


#: Removes the shuffle files of a query as soon as it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, path: str, *by: str) -> DataFrame:
    """``df`` written to ``path`` (a folder for each value of ``by``) and read back from there.

    The shuffle files behind it go when it is written.  Those of a checkpoint stay
    until the driver happens to collect garbage: a job of many steps, each small
    to the driver, would keep the files of all its steps."""
    with setting(df.sparkSession, CLEANUP, "true"):
        df.write.partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
