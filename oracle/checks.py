"""DuckDB oracles for ratings (M1-M3), data checks.

Check oracles are plain SQL per constraint (one SELECT per column or key,
UNION ALL), generated from the DDL constraint lists.
"""

from __future__ import annotations

from souk.catalog import DEFAULTS_BATCH_TS, RATINGS_SINCE
from souk.sources.migrate import OPTIONAL_FK
from souk.sources.schema import (DEFAULTS, ENUMS, FOREIGN_KEYS, NOT_NULL, RATING_CHECKS, SCHEMAS, TABLES, TIME_COLUMN, UNIQUE_KEYS,
                                 VARCHAR_LIMITS)
from oracle.queries import dbl

FAULTY = {"bookings": "faulty_bookings", "reviews": "faulty_reviews"}


def src(t: str) -> str:
    return FAULTY.get(t, t)


def _row(t, c, rule, row_id, detail):
    return (f"SELECT '{t}' AS table_name, '{c}' AS column_name, '{rule}' AS rule, "
            f"CAST({row_id} AS VARCHAR) AS row_id, CAST({detail} AS VARCHAR) AS detail")


def not_null_sql() -> str:
    parts = []
    for t in SCHEMAS:
        for c in ("id",) + NOT_NULL.get(t, ()):
            parts.append(f"{_row(t, c, 'not_null', 'id', 'NULL')} FROM {src(t)} WHERE {c} IS NULL")
    return "\nUNION ALL\n".join(parts)


def unique_sql() -> str:
    parts = []
    for t in SCHEMAS:
        for key in UNIQUE_KEYS.get(t, (("id",),)):
            nn = " AND ".join(f"{k} IS NOT NULL" for k in key)
            kid = "concat_ws('|', " + ", ".join(f"CAST({k} AS VARCHAR)" for k in key) + ")"
            folded = ", ".join(f"strip_accents(lower(CAST({k} AS VARCHAR)))" for k in key)
            parts.append(f"{_row(t, ','.join(key), 'unique', f'min({kid})', 'COUNT(*)')} FROM {src(t)} WHERE {nn} "
                         f"GROUP BY {folded} HAVING COUNT(*) > 1")
    return "\nUNION ALL\n".join(parts)


def enum_sql() -> str:
    parts = []
    for (t, c), dom in ENUMS.items():
        lst = ", ".join(f"'{v}'" for v in dom)
        parts.append(f"{_row(t, c, 'enum', 'id', c)} FROM {src(t)} WHERE {c} IS NOT NULL AND {c} NOT IN ({lst})")
    return "\nUNION ALL\n".join(parts)


def rating_sql() -> str:
    return "\nUNION ALL\n".join(
        f"{_row(t, c, 'rating_range', 'id', c)} FROM {src(t)} WHERE {c} IS NOT NULL AND {c} NOT BETWEEN 1 AND 5"
        for t, c in RATING_CHECKS)


def fk_sql() -> str:
    parts = []
    for fk in FOREIGN_KEYS:
        parts.append(f"{_row(fk.table, fk.column, 'foreign_key', 'c.id', 'c.' + fk.column)} FROM {src(fk.table)} c "
                     f"WHERE c.{fk.column} IS NOT NULL AND NOT EXISTS "
                     f"(SELECT 1 FROM {src(fk.parent)} p WHERE p.id = c.{fk.column})")
    return "\nUNION ALL\n".join(parts)


def ranges_sql() -> str:
    parts = []
    for (t, c), n in VARCHAR_LIMITS.items():
        parts.append(f"{_row(t, c, 'range', 'id', f'length({c})')} FROM {src(t)} WHERE length({c}) > {n}")
    for t, schema in SCHEMAS.items():
        for f in schema.fields:
            if f.dataType.typeName() == "decimal":
                ty = f"DECIMAL({f.dataType.precision},{f.dataType.scale})"
                parts.append(f"{_row(t, f.name, 'range', 'id', f.name)} FROM {src(t)} "
                             f"WHERE {f.name} IS NOT NULL AND TRY_CAST({f.name} AS {ty}) IS NULL")
    return "\nUNION ALL\n".join(parts)


def uuid_sql(table: str, expr: str) -> str:
    return (f"regexp_replace(substr(sha256('{table}' || '|' || {expr}), 1, 32), "
            r"'^(.{8})(.{4})(.{4})(.{4})(.{12})$', '\1-\2-\3-\4-\5')")


def rekey_sql(table: str) -> str:
    fks = [fk for fk in FOREIGN_KEYS if fk.table == table]
    exists = {fk.column: f"EXISTS (SELECT 1 FROM {fk.parent} p WHERE p.id = t.{fk.column})" for fk in fks}
    req = [exists[fk.column] for fk in fks if (table, fk.column) not in OPTIONAL_FK]
    row_ok = " AND ".join(req) if req else "TRUE"
    cols = []
    for c in SCHEMAS[table].fieldNames():
        fk = next((f for f in fks if f.column == c), None)
        if c == "id":
            cols.append(f"{uuid_sql(table, 't.id')} AS id")
        elif fk is not None:
            cols.append(f"CASE WHEN ({row_ok}) AND {exists[c]} THEN {uuid_sql(fk.parent, 't.' + c)} END AS {c}")
        else:
            cols.append(f"t.{c}")
    money = [f.name for f in SCHEMAS[table].fields if f.dataType.typeName() == "decimal"]
    body = f"SELECT {', '.join(cols)} FROM {table} t"
    return dbl(body, *money) if money else body


def defaults_sql(table: str) -> str:
    """The table with its default and time columns emptied in some rows and filled again."""
    cols = []
    for f in SCHEMAS[table].fields:
        if f.name in DEFAULTS[table]:
            v = DEFAULTS[table][f.name]
            v = str(v).upper() if isinstance(v, bool) else f"'{v}'" if isinstance(v, str) and f.dataType.typeName() == "string" else str(v)
        elif f.name == TIME_COLUMN[table]:
            v = f"TIMESTAMP '{DEFAULTS_BATCH_TS}'"
        else:
            cols.append(f.name)
            continue
        cols.append(f"CASE WHEN {f.name} IS NULL OR ascii(right(id, 1)) % 3 = 0 THEN {v} ELSE {f.name} END AS {f.name}")
    money = [f.name for f in SCHEMAS[table].fields if f.dataType.typeName() == "decimal"]
    body = f"SELECT {', '.join(cols)} FROM {table}"
    return dbl(body, *money) if money else body


def _avg2(s: str, n: str) -> str:
    """ROUND(ROUND(s/n, 4), 2) half-up in integers, as MySQL's AVG then ROUND."""
    a4 = f"((20000 * {s} + {n}) // (2 * {n}))"
    return f"(((2 * {a4} + 100) // 200) / 100.0)"


def ratings_sql(review_table: str, target: str, where: str = "") -> str:
    return f"""
WITH av AS (SELECT creator_id, {_avg2('SUM(rating)', 'COUNT(*)')} AS v FROM {review_table} {where}
            GROUP BY creator_id)
SELECT cp.id, COALESCE(av.v, CAST(cp.{target} AS DOUBLE)) AS {target}
FROM creator_profiles cp LEFT JOIN av ON av.creator_id = cp.id"""


SQL: dict[str, str] = {
    "m1_creator_ratings": ratings_sql("reviews", "rating"),
    "m2_collaboration_ratings": ratings_sql("collaboration_reviews", "collaboration_rating"),
    "m3_refresh_ratings": ratings_sql(
        "reviews", "rating",
        f"WHERE creator_id IN (SELECT creator_id FROM reviews WHERE created_at >= TIMESTAMP '{RATINGS_SINCE}')"),
    "c01_not_null": not_null_sql(),
    "c02_unique": unique_sql(),
    "c03_enum": enum_sql(),
    "c04_rating_range": rating_sql(),
    "c05_foreign_keys": fk_sql(),
    "c06_ranges": ranges_sql(),
    "c07_apply_defaults": dbl(f"""
SELECT id, brand_id, creator_id, package_id, campaign_id, COALESCE(status, 'pending') AS status, price, notes,
       content_url, content_type, CAST(NULL AS VARCHAR) AS content_note, rejection_reason,
       COALESCE(created_at, TIMESTAMP '{DEFAULTS_BATCH_TS}') AS created_at
FROM faulty_bookings""", "price"),
    "c08_unify_notifications": """
SELECT id, user_id, COALESCE(title, 'Notification') AS title, message, link, COALESCE(is_read, FALSE) AS is_read,
       created_at FROM notifications_new
UNION ALL
SELECT id, user_id, 'Notification', message, CAST(NULL AS VARCHAR), COALESCE(read_status, 0) <> 0, created_at
FROM notifications_old""",
    "c06_ranges_raw": "\nUNION ALL\n".join([
        f"{_row('payments', 'razorpay_order_id', 'range', 'id', 'length(razorpay_order_id)')} FROM raw_payments WHERE length(razorpay_order_id) > 200",
        f"{_row('payments', 'amount', 'range', 'id', 'amount')} FROM raw_payments WHERE TRY_CAST(amount AS DECIMAL(12,2)) IS NULL"]),
    **{f"c07_apply_defaults__{t}": defaults_sql(t) for t in DEFAULTS if t != "bookings"},
    **{f"c09_rekey__{t}": rekey_sql(t) for t in TABLES},
}
