"""Scalar semantics of the reference (MySQL defaults and JavaScript coercions)
as built-in Spark expressions.
"""

from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

CI_AI = "UNICODE_CI_AI"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def like_segments(text: str) -> list[tuple[int, list[tuple[int, str]]]]:
    """A LIKE pattern between its ``%``: per segment its length and the (offset,
    literal) pieces between its ``_``; a backslash takes the next character as it is."""
    out: list[tuple[int, list[tuple[int, str]]]] = []
    length, pieces, i = 0, [], 0
    while i <= len(text):
        ch = text[i] if i < len(text) else "%"
        if ch == "%":
            if length:
                out.append((length, pieces))
            length, pieces = 0, []
        elif ch == "_":
            length += 1
        else:
            if ch == "\\" and i + 1 < len(text):
                i, ch = i + 1, text[i + 1]
            if pieces and pieces[-1][0] + len(pieces[-1][1]) == length:
                pieces[-1] = (pieces[-1][0], pieces[-1][1] + ch)
            else:
                pieces.append((length, ch))
            length += 1
        i += 1
    return out


def like_any(col, text: str) -> Column:
    """``col LIKE '%text%'`` under MySQL's default case- and accent-insensitive
    collation; ``%`` and ``_`` in ``text`` are wildcards (the reference does not
    escape them), a backslash escapes one.  Literals compare under the collation
    whether there are wildcards or not, code point by code point.

    A text without wildcards is a collation-aware ``contains``.  Otherwise each
    segment between the ``%`` is sought from the end of the one before it; the
    first place that fits leaves most room for the rest, so there is no need to
    go back.  The text is cut into its code points once: a substring would walk
    to its place from the start of the text, at each place anew."""
    if not re.search(r"[%_\\]", text):
        return F.contains(F.collate(_c(col), CI_AI), F.lit(text))

    def found(chars: Column) -> Column:
        at = F.lit(1)
        for length, pieces in like_segments(text):
            at = F.get(F.transform(F.array(at), _sought(chars, F.length(_c(col)), length, pieces)), F.lit(0))
        return at.isNotNull()

    return F.when(_c(col).isNotNull(), F.get(F.transform(F.array(F.split(_c(col), "")), found), F.lit(0)))


def _sought(chars: Column, n: Column, length: int, pieces: list[tuple[int, str]]):
    """Where a segment's first match at or after a position of the ``n`` code points ends (null without one)."""

    def part(i: Column, size: int) -> Column:
        return F.get(chars, i - 1) if size == 1 else F.array_join(F.slice(chars, i, F.lit(size)), "")

    def fits(i: Column) -> Column:
        return reduce(lambda a, b: a & b, [F.collate(part(i + off, len(lit)), CI_AI) == F.lit(lit) for off, lit in pieces], F.lit(True))

    def end(p: Column) -> Column:
        starts = F.when(p + length - 1 <= n, F.sequence(p, n - length + 1))
        return F.array_min(F.filter(starts, fits)) + length

    return end


def js_truthy(value) -> bool:
    """JavaScript truthiness of a request value (query strings stay text, so
    ``"0"`` is truthy)."""
    return not (value is None or value == "" or value is False
                or (isinstance(value, (int, float)) and value == 0))


def js_parse_int(value) -> float | int:
    """``parseInt``: optional sign and leading digits, NaN otherwise."""
    m = re.match(r"\s*([+-]?\d+)", str(value))
    return int(m.group(1)) if m else math.nan


def js_parse_float(value) -> float:
    """``parseFloat``: longest decimal prefix, NaN otherwise."""
    m = re.match(r"\s*([+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?)", str(value))
    return float(m.group(1)) if m else math.nan


def col_truthy(col) -> Column:
    """Truthiness of a string payload column: null and '' are falsy."""
    c = _c(col)
    return c.isNotNull() & (c.cast("string") != F.lit(""))


def col_parse_float(col) -> Column:
    """``parseFloat`` over a string column (null where JS gives NaN)."""
    num = F.regexp_extract(_c(col).cast("string"), r"^\s*([+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?)", 1)
    return F.when(num != "", num).try_cast("double")


def col_parse_int(col) -> Column:
    num = F.regexp_extract(_c(col).cast("string"), r"^\s*([+-]?\d+)", 1)
    return F.when(num != "", num).try_cast("bigint")


def encode_uri_component(col) -> Column:
    """``encodeURIComponent`` from ``url_encode`` (form encoding) plus the
    differences: space is %20, and ! ' ( ) ~ stay literal."""
    c = F.url_encode(_c(col))
    for enc, lit in (("\\+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        c = F.regexp_replace(c, enc, lit)
    return c


def locale_amount(col) -> Column:
    """``Number.prototype.toLocaleString()`` on an en-US host:
    thousands separators and at most three fraction digits."""
    exact = F.round(_c(col).cast("decimal(38,12)"), 3)  # half away from zero, as JavaScript rounds
    return F.call_function("format_number", exact, F.lit("#,##0.###"))


def extname(col) -> Column:
    """Node ``path.extname``: the last ``.xxx`` of the final path part, lowercased;
    a part that only begins with a dot has none."""
    return F.lower(F.regexp_extract(_c(col), r"[^/\\](\.[^./\\]*)$", 1))


#: What JavaScript's trim removes, as the inside of a character class.
JS_SPACE = r"\s\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"


def js_not_blank(col) -> Column:
    """``text.trim()`` is truthy: false for null and for white space of any kind."""
    return F.coalesce(_c(col).rlike(f"[^{JS_SPACE}]"), F.lit(False))
