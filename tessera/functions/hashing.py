"""Key hashes of the ring and of replica selection, as expressions."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F


def ring_hash(key: Column) -> Column:
    """The first 32 bits of SHA-1, as a non-negative BIGINT."""
    return F.conv(F.substring(F.sha1(F.encode(key, "UTF-8")), 1, 8), 16, 10).cast("long")


def ring_hash_of(key: str) -> int:
    """The same hash of one key, on the driver."""
    return int(hashlib.sha1(key.encode()).hexdigest()[:8], 16)


def code_unit_hash(key: Column) -> Column:
    """``h = 31 h + unit`` over UTF-16 code units in 32-bit arithmetic, then the absolute value; empty: 0."""
    digits = F.hex(F.encode(key, "UTF-16BE"))
    units = F.when(F.length(digits) > 0, F.transform(F.sequence(F.lit(1), F.length(digits), F.lit(4)), lambda i: F.conv(F.substring(digits, i, F.lit(4)), 16, 10).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    raw = F.aggregate(units, F.lit(0).cast("long"), lambda h, c: F.pmod(h * 31 + c, F.lit(1 << 32)))
    return F.abs(F.when(raw >= 1 << 31, raw - (1 << 32)).otherwise(raw))


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 code units; null: 0."""
    return F.coalesce((F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("long"), F.lit(0).cast("long"))
