"""Schema-drift and key migrations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from souk.functions.ids import det_uuid
from souk.operators.checks import missing_parents
from souk.session import checkpoint_dir
from souk.sources.schema import FOREIGN_KEYS, SCHEMAS, TABLES
from souk.sources.tables import conform


def unify_notifications(old: DataFrame, new: DataFrame) -> DataFrame:
    """Notifications in the first shape (``read_status`` flag, no title
    or link) and in the later shape (``title, link, is_read``) as one table
    in the canonical shape.  Old rows get the added columns' defaults:
    title 'Notification', no link, is_read from read_status."""
    old_c = old.select(
        "id", "user_id", F.lit(None).cast("string").alias("title"), "message",
        F.lit(None).cast("string").alias("link"),
        (F.coalesce(F.col("read_status"), F.lit(0)) != 0).alias("is_read"), "created_at")
    both = new.unionByName(old_c, allowMissingColumns=True)
    return conform(both.withColumn("title", F.coalesce("title", F.lit("Notification")))
                       .withColumn("is_read", F.coalesce("is_read", F.lit(False))), "notifications")


# Foreign keys the key migration joins with LEFT JOIN (each
# key independently); all others are inner joins, where one missing parent
# leaves every new key of the row unset.
OPTIONAL_FK = {
    ("bookings", "brand_id"), ("bookings", "creator_id"), ("bookings", "package_id"),
    ("bookings", "campaign_id"), ("messages", "booking_id"), ("admin_logs", "admin_id"),
}


def new_key(table: str, old: F.Column) -> F.Column:
    """The replacement primary key of a row: uuid-shaped, from table and old key."""
    return F.when(old.isNotNull(), det_uuid(F.lit(table), old))


#: Missing parents that are broadcast, by their counted rows.
FEW_KEYS = 1_000_000


def orphan_index(m, tables=None) -> DataFrame:
    """The references without a parent (``missing_parents``), kept as a table."""
    checkpoint_dir(m.spark)
    lost = missing_parents(m, tables).checkpoint()
    return F.broadcast(lost) if lost.count() <= FEW_KEYS else lost


def rekey_table(m, table: str, lost: DataFrame | None = None) -> DataFrame:
    """C9 for one table: new ``id`` for every row and each foreign key mapped
    to its parent's new id.  A key whose parent is missing becomes null; for
    inner-joined keys a missing parent leaves all keys of the row null.

    The parent's new id is computed from the key itself, so all a row needs to
    know is whether a key has no parent: it looks that up in the index of such
    keys, which is broadcast while it is small, so the table is read once and
    not shuffled; null keys look up nothing."""
    df = m[table]
    fks = [fk for fk in FOREIGN_KEYS if fk.table == table]
    lost = lost if lost is not None or not fks else orphan_index(m, [table])
    flags = {}
    for fk in fks:
        gone = lost.filter(F.col("_pt") == fk.parent).select(F.col("_pv").alias(f"_gone_{fk.column}"))
        df = df.join(gone, df[fk.column] == F.col(f"_gone_{fk.column}"), "left")
        flags[fk.column] = F.col(fk.column).isNotNull() & F.col(f"_gone_{fk.column}").isNull()
    required = [flags[fk.column] for fk in fks if (table, fk.column) not in OPTIONAL_FK]
    row_ok = F.lit(True)
    for r in required:
        row_ok = row_ok & r
    out = []
    for c in SCHEMAS[table].fieldNames():
        if c == "id":
            out.append(new_key(table, F.col("id")).alias("id"))
            continue
        fk = next((f for f in fks if f.column == c), None)
        if fk is None:
            out.append(F.col(c))
        else:
            out.append(F.when(row_ok & flags[c], new_key(fk.parent, F.col(c))).alias(c))
    return df.select(*out)


def rekey_tables(m) -> dict[str, DataFrame]:
    """Every table rekeyed consistently (children reference the parents'
    new ids), all over one index of missing parents."""
    lost = orphan_index(m)
    return {t: rekey_table(m, t, lost) for t in TABLES}
