"""Data contracts of the DDL as DataFrame checks.

Every check returns violations in one shape, ``(table_name, column_name,
rule, row_id, detail)``, unioned over tables, so a caller can union all checks
and act on them with one plan.  Each table is scanned once per check with
only the columns that check needs.
"""

from __future__ import annotations

from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from souk.functions.text import CI_AI
from souk.session import checkpoint_dir
from souk.sources.schema import (DEFAULTS, ENUMS, FOREIGN_KEYS, NOT_NULL, RATING_CHECKS, SCHEMAS,
                                 TIME_COLUMN, UNIQUE_KEYS, VARCHAR_LIMITS)

VIOLATION_COLS = ["table_name", "column_name", "rule", "row_id", "detail"]


def _empty(spark) -> DataFrame:
    schema = T.StructType([T.StructField(c, T.StringType()) for c in VIOLATION_COLS])
    return spark.createDataFrame([], schema)


def _union(parts: list[DataFrame], spark) -> DataFrame:
    if not parts:
        return _empty(spark)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _per_column(df: DataFrame, table: str, rule: str, tests: list[tuple[str, Column, Column]]) -> DataFrame:
    """One scan: each row emits one violation per failing column test.  Rows
    that fail none are filtered first, by tests the scan can push down."""
    failing = reduce(lambda a, b: a | b, [bad for _, bad, _ in tests])
    hits = F.filter(F.array(*[F.when(bad, F.struct(F.lit(col).alias("c"), detail.cast("string").alias("d")))
                              for col, bad, detail in tests]), lambda x: x.isNotNull())
    return (df.filter(failing).select(F.col("id").cast("string").alias("row_id"), F.explode(hits).alias("v"))
              .select(F.lit(table).alias("table_name"), F.col("v.c").alias("column_name"), F.lit(rule).alias("rule"),
                      "row_id", F.col("v.d").alias("detail")))


def check_not_null(m, tables=None) -> DataFrame:
    """NOT NULL columns (and the primary key) that are null."""
    parts = []
    for t in tables or SCHEMAS:
        cols = ("id",) + NOT_NULL.get(t, ())
        parts.append(_per_column(m[t], t, "not_null", [(c, F.col(c).isNull(), F.lit(None)) for c in cols]))
    return _union(parts, m.spark)


def check_unique(m, tables=None) -> DataFrame:
    """Single and composite unique keys held by more than one row
    (rows with a null in the key are exempt, as in SQL).

    Every table contributes one row per unique key it declares —
    ``(table, key name, key values)`` — and all of them are counted by a
    single grouped aggregate: one shuffle for the whole check, with partial
    counts per task, so a duplicated hot key never gathers its rows.  Keys
    compare as the default collation does, without case and accents; the
    smallest spelling names a violation.

    Printable ASCII values are equal in that collation if they are in lower
    case, which is far cheaper to compare.  Only the keys that have any other
    value are counted again, whole, by the collation itself."""
    keys = {t: UNIQUE_KEYS.get(t, (("id",),)) for t in tables or SCHEMAS}
    if not keys:
        return _empty(m.spark)
    checkpoint_dir(m.spark)
    plain = F.when(~F.col("raw").rlike("[^ -~]"), F.lower("raw"))
    dup = _held_twice(_key_values(m, keys), plain).checkpoint()
    other = [(r["table_name"], r["column_name"]) for r in dup.filter("v is null").select("table_name", "column_name").collect()]
    again = {t: found for t in keys if (found := tuple(k for k in keys[t] if (t, ",".join(k)) in other))}
    if again:
        seen = F.concat_ws(" ", "table_name", "column_name").isin([" ".join(x) for x in other])
        dup = dup.filter(~seen).drop("v").unionByName(_held_twice(_key_values(m, again), F.collate("raw", CI_AI)).drop("v"))
    return dup.select("table_name", "column_name", F.lit("unique").alias("rule"), "row_id",
                      F.col("n").cast("string").alias("detail"))


def _key_values(m, keys: dict[str, tuple[tuple[str, ...], ...]]) -> DataFrame:
    """(table_name, column_name, raw): the value of every key without a null in it, each table read once."""
    parts = []
    for t in keys:
        entries = [F.when(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in key]),
                          F.struct(F.lit(",".join(key)).alias("c"), F.array_join(F.array(*[F.col(k).cast("string") for k in key]), "|").alias("raw")))
                   for key in keys[t]]
        parts.append(m[t].select(F.lit(t).alias("table_name"), F.explode(F.filter(F.array(*entries), lambda x: x.isNotNull())).alias("e"))
                         .select("table_name", F.col("e.c").alias("column_name"), "e.raw"))
    return reduce(DataFrame.unionByName, parts)


def _held_twice(values: DataFrame, v: Column) -> DataFrame:
    """The values that several rows have as ``v``, and one row for all without a ``v``."""
    return (values.groupBy("table_name", "column_name", v.alias("v"))
                  .agg(F.count(F.lit(1)).alias("n"), F.min("raw").alias("row_id")).filter("n > 1 or v is null"))


def check_enum(m, tables=None) -> DataFrame:
    """Status / role values outside their ENUM domain."""
    by_table: dict[str, list] = {}
    for (t, c), dom in ENUMS.items():
        if tables is None or t in tables:
            by_table.setdefault(t, []).append(
                (c, F.col(c).isNotNull() & ~F.col(c).isin(*dom), F.col(c)))
    return _union([_per_column(m[t], t, "enum", tests) for t, tests in by_table.items()], m.spark)


def check_rating_range(m) -> DataFrame:
    """C4: ratings outside CHECK (rating BETWEEN 1 AND 5)."""
    return _union([_per_column(m[t], t, "rating_range",
                               [(c, F.col(c).isNotNull() & ~F.col(c).between(1, 5), F.col(c))])
                   for t, c in RATING_CHECKS], m.spark)


def _foreign_keys(tables) -> list:
    return [fk for fk in FOREIGN_KEYS if tables is None or fk.table in tables]


def _references(m, fks) -> DataFrame:
    """Every non-null value of the keys ``fks``, each table read once: (_pt, _pv, table_name, column_name, row_id)."""
    refs = []
    for t in dict.fromkeys(fk.table for fk in fks):
        keys = F.array(*[F.struct(F.lit(fk.parent).alias("_pt"), F.col(fk.column).cast("string").alias("_pv"), F.lit(fk.column).alias("column_name"))
                         for fk in fks if fk.table == t])
        refs.append(m[t].select(F.col("id").cast("string").alias("row_id"), F.explode(keys).alias("_k")).filter("_k._pv is not null").select(
            "_k._pt", "_k._pv", F.lit(t).alias("table_name"), "_k.column_name", "row_id"))
    return reduce(DataFrame.unionByName, refs)


def _missing(m, fks) -> DataFrame:
    """(_pt, _pv, _by): parent table and value of every reference without a
    parent row, and which of ``fks`` refer to it (bit i: the i-th).

    Each table is read once and gives, for every row, its references and, if
    it is a parent, its own key, as (parent table, key value, which key, is a
    parent).  These are aggregated once, with partial results per task, so a
    hot key costs one row per task."""
    parents = {fk.parent for fk in fks}
    marks = []
    for t in dict.fromkeys([fk.table for fk in fks] + sorted(parents)):
        mark = lambda pt, col, by, par: F.struct(F.lit(pt).alias("_pt"), F.col(col).cast("string").alias("_pv"),
                                                 F.lit(by).cast("long").alias("_by"), F.lit(par).alias("_par"))
        own = [mark(t, "id", 0, 1)] if t in parents else []
        marks.append(m[t].select(F.explode(F.array(*own, *[mark(fk.parent, fk.column, 1 << i, 0) for i, fk in enumerate(fks) if fk.table == t])).alias("_m"))
                         .filter("_m._pv is not null").select("_m.*"))
    return (reduce(DataFrame.unionByName, marks).groupBy("_pt", "_pv").agg(F.bit_or("_by").alias("_by"), F.max("_par").alias("_par"))
            .filter("_by != 0 and _par = 0").select("_pt", "_pv", "_by"))


def missing_parents(m, tables=None) -> DataFrame:
    """(_pt, _pv): parent table and value of every reference without a parent row."""
    fks = _foreign_keys(tables)
    if not fks:
        return m.spark.createDataFrame([], "_pt string, _pv string")
    return _missing(m, fks).select("_pt", "_pv")


#: Missing values up to which they are sent to every task.
FEW_MISSING = 100_000


def check_foreign_keys(m, tables=None) -> DataFrame:
    """Child rows whose non-null foreign key has no parent row: the missing
    values, kept, join the references of those keys again that have any."""
    fks = _foreign_keys(tables)
    if not fks:
        return _empty(m.spark)
    checkpoint_dir(m.spark)
    lost = _missing(m, fks).checkpoint()
    n, by = lost.agg(F.count("*"), F.bit_or("_by")).first()
    if not n:
        return _empty(m.spark)
    lost = lost.select("_pt", "_pv")
    r = _references(m, [fk for i, fk in enumerate(fks) if by >> i & 1])
    return r.join(F.broadcast(lost) if n <= FEW_MISSING else lost, ["_pt", "_pv"]).select(
        "table_name", "column_name", F.lit("foreign_key").alias("rule"), "row_id", F.col("_pv").alias("detail"))


def check_ranges(m, tables=None) -> DataFrame:
    """Text longer than its VARCHAR(n) and numbers that overflow their
    DECIMAL(p,s) (``try_cast`` is null exactly where the value does not fit).
    Tables may be as they came in, with numbers as text or wider decimals: a
    table that conforms already cannot hold one that overflows."""
    by_table: dict[str, list] = {}
    for (t, c), n in VARCHAR_LIMITS.items():
        if tables is None or t in tables:
            by_table.setdefault(t, []).append((c, F.length(c) > n, F.length(c)))
    for t, schema in SCHEMAS.items():
        if tables is not None and t not in tables:
            continue
        for f in schema.fields:
            if isinstance(f.dataType, T.DecimalType):
                col = F.col(f.name)
                by_table.setdefault(t, []).append(
                    (f.name, col.isNotNull() & col.try_cast(f.dataType).isNull(), col))
    return _union([_per_column(m[t], t, "range", tests) for t, tests in by_table.items()], m.spark)


def apply_defaults(table: str, df: DataFrame, batch_ts=None) -> DataFrame:
    """Fill missing values with the DDL defaults; ``created_at`` (or
    ``joined_at``) takes the batch timestamp, the job's CURRENT_TIMESTAMP."""
    defaults = DEFAULTS.get(table, {})
    types = {f.name: f.dataType for f in SCHEMAS[table].fields}
    tcol = TIME_COLUMN.get(table)
    out = []
    for c in df.columns:
        col = F.col(c)
        if c in defaults:
            v = defaults[c]
            lit = F.lit(Decimal(v) if isinstance(types[c], T.DecimalType) else v).cast(types[c])
            col = F.coalesce(col, lit)
        elif c == tcol and batch_ts is not None:
            col = F.coalesce(col, F.lit(batch_ts).cast(types[c]))
        out.append(col.alias(c))
    return df.select(*out)


def all_checks(m) -> DataFrame:
    """C1-C6 in one DataFrame."""
    return (check_not_null(m).unionByName(check_unique(m)).unionByName(check_enum(m))
            .unionByName(check_rating_range(m)).unionByName(check_foreign_keys(m))
            .unionByName(check_ranges(m)))
