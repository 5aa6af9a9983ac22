"""Shared DataFrame building blocks (paging, per-key top-n, nesting, gates,
last-write-wins, upserts).  All are plain Catalyst plans: no Python per row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from souk.session import checkpoint_dir, stored


def _cols(cols) -> list[Column]:
    if isinstance(cols, (str, Column)):
        cols = [cols]
    return [F.col(c) if isinstance(c, str) else c for c in cols]


def order_if_keyed(df: DataFrame, key, *order) -> DataFrame:
    """The reference orders the rows of *one* key.  Asked for one key, the
    result is ordered; asked set-wide, rows of all keys come back unordered
    (a total order over every key would be a full range-partitioned sort
    with no meaning) — order per key downstream if needed."""
    return df.orderBy(*_cols(list(order))) if key is not None else df


def paginate(df: DataFrame, order: Sequence, page: int = 1, limit: int = 12) -> DataFrame:
    """``ORDER BY … LIMIT limit OFFSET (page-1)*limit``.

    Page 1 plans as TakeOrderedAndProject (a per-partition top-k and one
    small merge); later pages add an offset on top of the same top-k.
    """
    page, limit = int(page), int(limit)
    ordered = df.orderBy(*_cols(order))
    off = (page - 1) * limit
    if off > 0:
        return ordered.limit(off + limit).offset(off)
    return ordered.limit(limit)


def page_count(total: Column, limit: int) -> Column:
    """``Math.ceil(total / limit)``."""
    return F.ceil(total.cast("double") / F.lit(float(limit))).cast("bigint")


def top_n_per_key(df: DataFrame, keys, order: Sequence, n: int, rank_col: str | None = None) -> DataFrame:
    """Per-key ``ORDER BY … LIMIT n``: ``row_number() ≤ n``.

    Catalyst turns the filter into a WindowGroupLimit below the shuffle, so
    each map task keeps at most n rows per key before exchanging them.
    """
    w = Window.partitionBy(*_cols(keys)).orderBy(*_cols(order))
    name = rank_col or "_rn"
    out = df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= n)
    return out if rank_col else out.drop(name)


def nest(df: DataFrame, key: str, fields: Sequence[str], order: Sequence[str] | None = None,
         name: str = "items") -> DataFrame:
    """``key → array<struct<fields>>`` ordered by ``order`` (then by the fields).

    ``collect_list`` is a partial aggregate: each map task builds its part
    of every array before the shuffle.
    """
    order = list(order or [])
    sort_struct = F.struct(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)],
                           F.struct(*[F.col(c) for c in fields]).alias("_v"))
    arr = F.sort_array(F.collect_list(sort_struct))
    return df.groupBy(key).agg(F.transform(arr, lambda s: s["_v"]).alias(name))


def first_reason(*gates: tuple[Column, str]) -> Column:
    """Reason of the first failing gate, null when all pass.

    ``gates`` are ``(passes, reason)`` in the reference's check order;
    a null ``passes`` counts as failing, like a missing row.
    """
    expr = None
    for ok, reason in gates:
        fail = F.coalesce(~ok, F.lit(True))
        expr = F.when(fail, F.lit(reason)) if expr is None else expr.when(fail, F.lit(reason))
    return expr if expr is not None else F.lit(None).cast("string")


def last_by(df: DataFrame, keys, seq: str, values: Sequence[str]) -> DataFrame:
    """Last write wins: per key, the values of the row with the highest seq."""
    st = F.max_by(F.struct(*[F.col(v) for v in values]), F.col(seq)).alias("_last")
    return (df.groupBy(*_cols(keys)).agg(st, F.max(seq).alias(seq))
              .select(*keys if not isinstance(keys, str) else [keys], seq,
                      *[F.col("_last")[v].alias(v) for v in values]))


def update_by_key(table: DataFrame, changes: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    """``UPDATE table SET cols = changes.cols WHERE table.key = changes.key``.

    ``changes`` holds at most one row per key; a left join keeps every
    untouched row and its partitioning.  Values are overwritten even when
    null (the reference writes whatever the request carried).
    """
    ch = changes.select(F.col(key).alias("_k"), F.lit(True).alias("_hit"),
                        *[F.col(c).alias(f"_n_{c}") for c in cols])
    j = table.join(ch, table[key] == ch["_k"], "left")
    out = [F.when(F.col("_hit"), F.col(f"_n_{c}")).otherwise(table[c]).alias(c)
           if c in cols else table[c] for c in table.columns]
    return j.select(*out)


def upsert(table: DataFrame, rows: DataFrame, key: str, update_cols: Sequence[str]) -> DataFrame:
    """``INSERT … ON DUPLICATE KEY UPDATE update_cols``: rows whose key exists
    only update ``update_cols``; new keys are inserted whole."""
    existing = update_by_key(table, rows.select(key, *update_cols), key, update_cols)
    new_rows = rows.join(table.select(key), key, "left_anti")
    return existing.unionByName(new_rows.select(*table.columns))


def in_batch_first(df: DataFrame, keys, seq: str, flag: str = "_first") -> DataFrame:
    """Mark the first row per key by seq (first-wins uniqueness inside a batch)."""
    w = Window.partitionBy(*_cols(keys)).orderBy(F.col(seq))
    return df.withColumn(flag, F.row_number().over(w) == 1)


def ranged(df: DataFrame, keys: Sequence[str], order: Sequence[str], ranges: int | None = None, path: str | None = None) -> DataFrame:
    """``df`` cut into ``ranges`` (the session's shuffle partitions) slices of the
    total order by keys and ``order``, about equal in rows however the keys or
    the order values are spread; ``_rg`` numbers them in that order.  A key
    with a third of all rows lies in a third of the slices.

    The cuts are sampled, so the rows are checkpointed with their numbers:
    whatever reads them later sees the same ones.  With ``path`` they are kept
    there, a folder a slice, so that a reader of some slices reads only those."""
    n = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    checkpoint_dir(df.sparkSession)
    cut = df.repartitionByRange(n, *keys, *order).withColumn("_rg", F.spark_partition_id())
    return stored(cut, path, "_rg") if path else cut.checkpoint()


def last_before(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: dict[str, Column],
                ranges: int | None = None, after: bool = False) -> DataFrame:
    """Per row and for each name of ``values``: the last non-null value of an
    earlier row (by ``order``) of the same keys, as ``last(value, ignorenulls)``
    over the preceding rows would give; with ``after`` the first one of a later row.

    One segmented scan: the running values inside each slice of ``ranged``, a
    summary row for each slice of the keys that lie in several (at most two
    keys a slice do without filling it, so no more than twice as many rows as
    slices), a prefix over the summaries and a broadcast of it."""
    cols = list(df.columns)
    d = ranged(df.withColumns({f"_v_{n}": v for n, v in values.items()}), keys, order, ranges)
    by = [F.col(c).desc() if after else F.col(c) for c in order]
    before = lambda *p: Window.partitionBy(*p).orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    local = d.select(*cols, "_rg", *[F.last(f"_v_{n}", ignorenulls=True).over(before(*keys, "_rg")).alias(f"_l_{n}") for n in values])

    wide = d.groupBy(*keys).agg(F.min("_rg").alias("_lo"), F.max("_rg").alias("_hi")).filter("_lo < _hi").select(*keys)
    pos = F.struct(*order)
    pick = F.min_by if after else F.max_by
    own = d.join(F.broadcast(wide), list(keys), "left_semi").groupBy(*keys, "_rg").agg(
        *[pick(f"_v_{n}", F.when(F.col(f"_v_{n}").isNotNull(), pos)).alias(f"_s_{n}") for n in values])
    over = Window.partitionBy(*keys).orderBy(F.col("_rg").desc() if after else "_rg").rowsBetween(Window.unboundedPreceding, -1)
    carried = own.select(*keys, "_rg", *[F.last(f"_s_{n}", ignorenulls=True).over(over).alias(f"_c_{n}") for n in values])
    out = local.join(F.broadcast(carried), [*keys, "_rg"], "left")
    return out.select(*cols, *[F.coalesce(f"_l_{n}", f"_c_{n}").alias(n) for n in values])
