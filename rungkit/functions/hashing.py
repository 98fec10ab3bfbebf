"""Hash-derived randomness contract.

``h32(x)``   = first 8 hex digits of md5(string(x)) as an unsigned 32-bit int.
``uniform``  = h32(concat_ws(':', seed, draw)) / 2**32, in [0, 1).

The same values are reproducible in SQL engines (DuckDB:
``('0x'||substr(md5(x),1,8))::BIGINT``), so every random choice in the
library can be checked by an oracle and is stable under retries.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_32 = 4294967296.0


def _col(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def h32(x) -> Column:
    return F.conv(F.substring(F.md5(_col(x).cast("string")), 1, 8), 16, 10).cast("bigint")


def hash_key(*parts) -> Column:
    """h32 of the ':'-joined string form of the parts (ints / strings only)."""
    return h32(F.concat_ws(":", *[_col(p).cast("string") for p in parts]))


def uniform(*parts) -> Column:
    return hash_key(*parts) / F.lit(TWO_32)


def sql_h32(expr: str) -> str:
    """DuckDB twin of :func:`h32` (for oracle SQL)."""
    return f"('0x' || substr(md5(CAST({expr} AS VARCHAR)), 1, 8))::BIGINT"


def sql_hash_key(*exprs: str) -> str:
    joined = " || ':' || ".join(f"CAST({e} AS VARCHAR)" for e in exprs)
    return sql_h32(joined)


def sql_uniform(*exprs: str) -> str:
    return f"({sql_hash_key(*exprs)} / 4294967296.0)"
