"""Independent DuckDB oracle for the registered driver queries.

Each oracle is a translation of the reference's SQL text (joins kept as the
reference wrote them: fan-out joins, OR joins, correlated subqueries), run
over the same stand-in tables, which are prefixed as CTEs.
"""

from __future__ import annotations

import re

from pyspark.sql import types as T

from souk.sources import fixtures
from souk.sources.schema import SCHEMAS, TABLES

_WORD = {t: re.compile(rf"\b{t}\b") for t in TABLES}


def _duck_type(dt: T.DataType) -> str:
    if isinstance(dt, T.StringType):
        return "VARCHAR"
    if isinstance(dt, T.IntegerType):
        return "INTEGER"
    if isinstance(dt, T.LongType):
        return "BIGINT"
    if isinstance(dt, T.BooleanType):
        return "BOOLEAN"
    if isinstance(dt, (T.TimestampNTZType, T.TimestampType)):
        return "TIMESTAMP"
    if isinstance(dt, T.DecimalType):
        return f"DECIMAL({dt.precision},{dt.scale})"
    raise TypeError(dt)


def _canonical_cte(name: str, present: set[str]) -> str:
    cols = []
    for f in SCHEMAS[name].fields:
        src = f.name if f.name in present else "NULL"
        cols.append(f"CAST({src} AS {_duck_type(f.dataType)}) AS {f.name}")
    return f"{name} AS (SELECT {', '.join(cols)} FROM fx_{name})"


# Columns each fixture definition produces (the canonical tables add the
# rest as typed nulls).
FIXTURE_COLUMNS: dict[str, set[str]] = {
    "users": {"id", "name", "email", "role", "avatar_url", "created_at"},
    "bookings": {"id", "k", "brand_id", "creator_id", "package_id", "campaign_id", "status", "price", "notes",
                 "created_at", "content_url", "content_type", "rejection_reason"},
    "payments": {"id", "booking_id", "razorpay_order_id", "amount", "payment_status", "created_at"},
}


def compose(body: str) -> str:
    """``WITH <stand-in tables the body reads> <body>``.

    ``body`` is a SELECT, optionally preceded by its own ``WITH a AS (...), ...``.
    """
    extra = ""
    text = body.strip()
    recursive = text[:15].upper() == "WITH RECURSIVE "
    if recursive:
        text = "WITH " + text[15:]
    if text[:5].upper() == "WITH ":
        # split "WITH x AS (...), y AS (...) SELECT ..." at the top-level SELECT
        depth, i = 0, 5
        while i < len(text):
            ch = text[i]
            if ch == "(":
                depth += 1
            elif ch == ")":
                depth -= 1
            elif depth == 0 and text[i:i + 6].upper() == "SELECT" and not text[i - 1].isalnum():
                break
            i += 1
        extra, text = text[5:i].strip(), text[i:]
    used = [t for t in TABLES if _WORD[t].search(body)]
    extras = [x for x in fixtures.EXTRA_SQL if re.search(rf"\b{x}\b", body)]
    need = fixtures.closure(used + extras)
    ctes = []
    for name in need:
        sql = fixtures.sql_for(name, "duckdb").format(**{r: (f"fx_{r}" if r in fixtures.FIXTURE_SQL else r)
                                               for r in fixtures.references(name)})
        cte_name = f"fx_{name}" if name in fixtures.FIXTURE_SQL else name
        ctes.append(f"{cte_name} AS ({sql.strip()})")
    for name in used:
        present = FIXTURE_COLUMNS.get(name) or {f.name for f in SCHEMAS[name].fields}
        ctes.append(_canonical_cte(name, present))
    if extra:
        ctes.append(extra)
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(ctes) + "\n" + text
