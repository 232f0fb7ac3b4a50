"""Seeded, engine-portable pseudo-randomness from md5.

md5 is used (not xxhash64) because the same numbers can be computed by any SQL
engine, which makes sampling and injection reproducible and checkable.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


HASH_HEX = 15  # 60 bits: fits a signed bigint
HASH_SPACE = 16**HASH_HEX


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def hash_key(*parts) -> Column:
    """Key text ``p1|p2|...`` hashed with md5 (hex)."""
    cols = [_c(p).cast("string") if not isinstance(p, (int, float)) else F.lit(str(p)) for p in parts]
    return F.md5(F.concat_ws("|", *cols))


def hash_int(*parts) -> Column:
    """Non-negative 60-bit integer from md5 of the key parts."""
    return F.conv(F.substring(hash_key(*parts), 1, HASH_HEX), 16, 10).cast("long")


def hash_unit(*parts) -> Column:
    """Uniform value in [0, 1) from md5 of the key parts."""
    return hash_int(*parts) / F.lit(float(HASH_SPACE))


def random_digits(n: int, *parts) -> Column:
    """An n-digit number in [10^(n-1), 10^n), seeded by the key parts (n <= 17)."""
    lo = 10 ** (n - 1)
    width = 10**n - lo
    return (F.lit(lo) + F.pmod(hash_int(*parts), F.lit(width))).cast("long")


def random_token(length: int, *parts) -> Column:
    """Alphanumeric token of ``length`` (<= 21) characters.

    The base64 text of the 16-byte md5 digest, with '+' and '/' mapped to 'x'
    and 'y': built-in expressions only, no per-character lambda.
    """
    if not 1 <= length <= 21:
        raise ValueError("token length must be in 1..21")
    b64 = F.base64(F.unhex(hash_key(*parts)))
    return F.translate(F.substring(b64, 1, length), "+/", "xy")
