"""The table bundle ``m`` and its sources and sinks.

``Market`` maps table names to DataFrames.  Tables are built lazily: asking
for ``m["payments"]`` plans only what payments needs, and Catalyst prunes
the columns a query does not read down to the parquet scan.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from souk.sources import fixtures
from souk.sources.schema import SCHEMAS, TABLES, TIME_COLUMN


class Market(Mapping):
    """Name → DataFrame, built on first use and then reused."""

    def __init__(self, spark: SparkSession, builder: Callable[[str], DataFrame],
                 extra: Callable[[str], DataFrame] | None = None, rows: Callable[[str], int] | None = None):
        self.spark = spark
        self._builder = builder
        self._extra = extra
        self._rows = rows
        self._frames: dict[str, DataFrame] = {}

    def fixture(self, name: str) -> DataFrame:
        """A named extra input (commands, drifted shapes, faulty tables)."""
        if self._extra is None:
            raise KeyError(f"no extra inputs in this bundle: {name}")
        return self._extra(name)

    def dealt(self, name: str, df: DataFrame, *by: str, times: int = 1) -> DataFrame:
        """``df``, made from the table ``name`` with up to ``times`` rows for each of its,
        dealt by ``by`` to tasks of ``TASK_ROWS`` rows if the table is known to be large.
        Otherwise Spark decides, by bytes: repetitive ids are packed so tightly that a
        task gets millions of rows."""
        n = self._rows(name) * times if self._rows else 0
        return df.repartition(-(-n // TASK_ROWS), *by) if n > FEW_ROWS else df

    def merged(self, name: str, df: DataFrame) -> DataFrame:
        """``df``, kept as files and made from the table ``name``, marked for merge joins if
        the table is known to be large (see ``derive_tables``)."""
        return df.hint("merge") if self._rows and self._rows(name) > FEW_ROWS else df

    def __getitem__(self, name: str) -> DataFrame:
        if name not in SCHEMAS:
            raise KeyError(name)
        if name not in self._frames:
            self._frames[name] = self._builder(name)
        return self._frames[name]

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in SCHEMAS:
            raise AttributeError(name)
        return self[name]

    def __iter__(self) -> Iterator[str]:
        return iter(TABLES)

    def __len__(self) -> int:
        return len(TABLES)

    def replace(self, **frames: DataFrame) -> "Market":
        """A new bundle with some tables swapped (the result of a job)."""
        base = self

        def build(name: str) -> DataFrame:
            return frames[name] if name in frames else base[name]

        return Market(self.spark, build, self._extra, self._rows)


def conform(df: DataFrame, table: str) -> DataFrame:
    """Project ``df`` onto the canonical schema: cast present columns, add
    missing ones as typed nulls, drop anything else (helper columns)."""
    have = set(df.columns)
    cols = []
    for f in SCHEMAS[table].fields:
        src = F.col(f.name) if f.name in have else F.lit(None)
        cols.append(src.cast(f.dataType).alias(f.name))
    return df.select(*cols)


def read_raw(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {t: spark.read.parquet(os.path.join(sf_dir, f"{t}.parquet")) for t in fixtures.RAW_TABLES}


#: Rows up to which the file size may decide that a table is broadcast.
FEW_ROWS = 1_000_000
#: Rows of a spread table that a task joins and groups, on average.
TASK_ROWS = 500_000
#: Rows up to which a raw table is sent whole to the tasks of a large one, so that its few keys do not make their number.
TINY_ROWS = 1_000
#: (derived table, table it reads) -> the key of their join or of its groups, by which the latter is dealt out beforehand.
SPREAD = {("collaboration_requests", "lineitem"): "l_partkey", ("promotion_packages", "lineitem"): "l_partkey",
          ("bookings", "orders"): "o_orderkey", ("bookings", "lineitem"): "l_orderkey",
          ("campaigns", "orders"): "o_custkey", ("collaborations", "lineitem"): "l_partkey",
          ("collaboration_reviews", "collaboration_participants"): "collaboration_id",
          ("collaboration_messages", "collaboration_participants"): "collaboration_id"}


def derive_tables(spark: SparkSession, sf_dir: str, stage_dir: str | None = None) -> Market:
    """Marketplace tables derived from the driver's parquet (FIXTURES.md §2).

    With ``stage_dir`` every stand-in table is written there once and read
    back, so tables that several others derive from are computed once and
    their lineage is cut (use a shared folder on a cluster).

    Spark takes a table's size from its compressed file and the columns read,
    so it broadcasts millions of short keys.  Tables of more than ``FEW_ROWS``
    rows (counted from the file footers) and what derives from them are marked
    for merge joins; smaller ones are joined as Spark sees fit, but those of up
    to ``TINY_ROWS`` are broadcast to large ones.  For the same reason it merges
    shuffle partitions until a task sorts and groups millions of rows, and groups
    what it scans beforehand in tasks that grow with the file, so ``SPREAD`` deals
    such tables to tasks of ``TASK_ROWS`` rows."""
    raw = read_raw(spark, sf_dir)
    fx: dict[str, DataFrame] = {}
    rows: dict[str, int] = {}

    def size(name: str) -> int:
        """The rows of a raw table; of a derived one the rows of the largest raw table behind it."""
        if name not in rows:
            rows[name] = raw[name].count() if name in raw else max(map(size, fixtures.references(name)), default=0)
        return rows[name]

    def sized(name: str, df: DataFrame, spread_by: str | None = None) -> DataFrame:
        if size(name) <= FEW_ROWS:
            return df
        if spread_by:
            df = df.repartition(-(-size(name) // TASK_ROWS), spread_by)
        return df.hint("merge")

    def read_by(name: str, r: str) -> DataFrame:
        """The table ``r`` as the definition of ``name`` reads it."""
        df = sized(r, raw[r] if r in raw else fixture(r), SPREAD.get((name, r)))
        return df.hint("broadcast") if r in raw and size(r) <= TINY_ROWS and size(name) > FEW_ROWS else df

    def fixture(name: str) -> DataFrame:
        if name not in fx:
            args = {r: read_by(name, r) for r in fixtures.references(name)}
            df = spark.sql(fixtures.sql_for(name, "spark"), **args)
            if stage_dir is not None:
                path = os.path.join(stage_dir, name)
                df.write.mode("overwrite").parquet(path)
                df = spark.read.parquet(path)
            fx[name] = df
        return fx[name]

    return Market(spark, lambda name: sized(name, conform(fixture(name), name)), lambda name: sized(name, fixture(name)), size)


COMMITTED = "_COMMITTED"
MANIFEST = "_MANIFEST.json"


def _hadoop(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _read_text(spark: SparkSession, path: str) -> str | None:
    fs, p = _hadoop(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def _manifest(spark: SparkSession, path: str) -> dict[str, dict] | None:
    text = _read_text(spark, f"{path}/{MANIFEST}")
    return json.loads(text) if text else None


def load_tables(spark: SparkSession, path: str) -> Market:
    """Read the 21 tables of a published version with their fixed schemas:
    ``{path}/{table}``, or the folders its manifest names.  A folder without
    the commit marker is refused."""
    fs, marker = _hadoop(spark, f"{path}/{COMMITTED}")
    if not fs.exists(marker):
        raise FileNotFoundError(f"{path} holds no committed version")
    manifest = _manifest(spark, path)

    def read(name: str) -> DataFrame:
        if manifest is None:
            return spark.read.schema(SCHEMAS[name]).parquet(f"{path}/{name}")
        folders = [x["path"] for x in manifest[name].values()]
        return spark.read.schema(SCHEMAS[name]).parquet(*folders) if folders else spark.createDataFrame([], SCHEMAS[name])

    return Market(spark, read)


def _new_version(spark: SparkSession, path: str) -> None:
    """Only a committed version stands; what a failed write has left is written over."""
    fs, marker = _hadoop(spark, f"{path}/{COMMITTED}")
    if fs.exists(marker):
        raise FileExistsError(f"{path} holds a committed version")


def write_tables(m: Mapping[str, DataFrame], path: str, tables=None, mode: str = "errorifexists") -> str:
    """S3: publish tables whole under a new version directory ``path``
    (``publish`` writes only what changed).

    The tables are written one after the other; the commit marker comes last,
    and ``load_tables`` refuses a version without it, so a reader sees all of a
    version or nothing of it.  A write that failed can be run again.
    """
    names = list(tables or TABLES)
    spark = m[names[0]].sparkSession
    if mode == "errorifexists":
        _new_version(spark, path)
        mode = "overwrite"
    fs, marker = _hadoop(spark, f"{path}/{COMMITTED}")
    fs.delete(marker, False)
    for name in names:
        conform(m[name], name).write.mode(mode).parquet(f"{path}/{name}")
    fs.create(marker, False).close()
    return path


#: Parts of a table without a time column.
PARTS = 16


def _part_of(table: str) -> F.Column:
    """A row's part: the month of its time, where jobs mostly change recent rows; else a hash of its id."""
    time = TIME_COLUMN[table]
    if time:
        return F.coalesce(F.date_format(time, "yyyy-MM"), F.lit("none"))
    return F.concat(F.lit("h"), F.pmod(F.xxhash64("id"), F.lit(PARTS)))


def publish(m: Mapping[str, DataFrame], path: str, base: str | None = None, changed=None) -> str:
    """S3: publish a version by parts, writing only those that differ from the
    version ``base``.

    A manifest names the folder of every part with its number of rows and the
    sum of their hashes.  A part with the same rows as in ``base`` is not
    written: the new manifest names the old folder (so a version lives as long
    as a later one names its folders).  Tables not in ``changed`` (default:
    all are looked at) are not even read.  Manifest and commit marker come
    last; a write that failed can be run again."""
    spark = m[TABLES[0]].sparkSession
    _new_version(spark, path)
    old = (_manifest(spark, base) if base else None) or {}
    if base and not old:
        raise FileNotFoundError(f"{base} has no manifest")
    new: dict[str, dict] = {}
    for name in TABLES:
        if changed is not None and name not in changed and name in old:
            new[name] = old[name]
            continue
        rows = conform(m[name], name).withColumn("part", _part_of(name))
        digest = F.sum(F.xxhash64(*SCHEMAS[name].fieldNames()).cast("decimal(38,0)")).cast("string")
        found = {r["part"]: [r["n"], r["digest"]] for r in rows.groupBy("part").agg(F.count("*").alias("n"), digest.alias("digest")).collect()}
        same = {k: x for k, x in old.get(name, {}).items() if found.get(k) == x["rows"]}
        touched = sorted(set(found) - set(same))
        if touched:
            rows.filter(F.col("part").isin(touched)).write.mode("overwrite").partitionBy("part").parquet(f"{path}/{name}")
        new[name] = same | {k: {"rows": found[k], "path": f"{path}/{name}/part={k}"} for k in touched}
    fs, file = _hadoop(spark, f"{path}/{MANIFEST}")
    out = fs.create(file, True)
    out.write(bytearray(json.dumps(new).encode()))
    out.close()
    fs.create(_hadoop(spark, f"{path}/{COMMITTED}")[1], False).close()
    return path
