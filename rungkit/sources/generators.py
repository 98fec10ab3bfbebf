"""Parity text generators driven by an id column (ops 8, 9).

Values come from the md5 hash contract, so a row's sequence depends only
on (seed, id, position): generation is map-only, restartable and
reproducible in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rungkit.functions.hashing import hash_key


def _values(idc: Column, tag: str, length: int, bit_width: int, seed) -> Column:
    m = F.lit(1 << bit_width)
    return F.transform(F.sequence(F.lit(0), F.lit(length - 1)),
                       lambda i: F.pmod(hash_key(F.lit(seed), idc, F.lit(tag), i), m).cast("int"))


def _fmt(arr: Column) -> Column:
    return F.array_join(F.transform(arr, lambda v: v.cast("string")), " ")


def _interleave(y: Column, z: Column) -> Column:
    return F.array_join(F.flatten(F.zip_with(y, z, lambda a, b: F.array(a.cast("string"), b.cast("string")))), " ")


def prefix_xor(d: Column) -> Column:
    """Running xor: out[i] = d[0] ^ ... ^ d[i]."""
    return F.aggregate(d, F.array().cast("array<int>"),
                       lambda acc, v: F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)).bitwiseXOR(v))))


def gen_parity(ids: DataFrame, key: str, length: int = 8, bit_width: int = 1, seed=0,
               cumulative: bool = False) -> DataFrame:
    """x, y random sequences; z = x ^ y (or running xor); prompt 'x x x', answer 'y z y z ..'."""
    idc = F.col(key)
    d = ids.select(key, _values(idc, "x", length, bit_width, seed).alias("_x"),
                   _values(idc, "y", length, bit_width, seed).alias("_y"))
    xy = F.zip_with("_x", "_y", lambda a, b: a.bitwiseXOR(b))
    z = prefix_xor(xy) if cumulative else xy
    return d.select(key, _fmt(F.col("_x")).alias("x_text"), _interleave(F.col("_y"), z).alias("answer"))
