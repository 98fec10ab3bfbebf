"""Skew-safe top-k per group.

Phase 1 keeps the first k rows of each (group, salt) slice, phase 2 the
first k of each group among at most ``salts * k`` survivors. A group
holding a third of the table is sorted in ``salts`` parallel slices.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SALTS = 64


def top_k_per_group(df: DataFrame, group: str, order: str, k: int, salts: int = SALTS) -> DataFrame:
    d = df.withColumn("_salt", F.pmod(F.xxhash64(F.col(order)), F.lit(salts)))
    w1 = Window.partitionBy(group, "_salt").orderBy(order)
    d = d.withColumn("_r", F.row_number().over(w1)).filter(F.col("_r") <= k)
    w2 = Window.partitionBy(group).orderBy(order)
    return d.withColumn("_r", F.row_number().over(w2)).filter(F.col("_r") <= k).drop("_r", "_salt")
