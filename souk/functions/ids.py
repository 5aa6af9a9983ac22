"""Deterministic ids and message authentication as JVM expressions."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F


def det_uuid(*parts) -> Column:
    """A uuid-shaped id from ``sha256(parts joined by '|')``.

    The reference draws random UUIDs; a deterministic id makes re-runs and
    stream retries idempotent.
    """
    h = F.sha2(F.concat_ws("|", *[F.col(p) if isinstance(p, str) else p for p in parts]), 256)
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4),
                       F.substring(h, 17, 4), F.substring(h, 21, 12))


def hmac_sha256_hex(key: bytes | str, message: Column) -> Column:
    """RFC 2104 HMAC-SHA256 of ``message`` (string column) as lowercase hex,
    built from two nested ``sha2`` calls over padded key bytes."""
    k = key.encode() if isinstance(key, str) else key
    if len(k) > 64:
        k = hashlib.sha256(k).digest()
    k = k.ljust(64, b"\x00")
    ipad = bytes(b ^ 0x36 for b in k)
    opad = bytes(b ^ 0x5C for b in k)
    inner = F.unhex(F.sha2(F.concat(F.lit(ipad), message.cast("binary")), 256))
    return F.sha2(F.concat(F.lit(opad), inner), 256)
