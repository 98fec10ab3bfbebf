"""Blocked prefix sums over a dense position, without a one-task window.

Rows are cut into blocks of positions; sums run inside a block, block totals
are summed over one row a block, and joined back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rungkit.operators.materialize import materialize

BLOCK = 4096


def prefix_sums(df: DataFrame, at: str, columns: dict[str, str], block: int = BLOCK) -> DataFrame:
    """``df`` (one row per integer ``at``) with, for each {name: column}, the
    sum of ``column`` (null counts as zero) up to and including the row."""
    d = df.withColumn("_block", F.floor(F.col(at) / F.lit(block)))
    w = Window.partitionBy("_block").orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumns({f"_in_{n}": F.sum(F.coalesce(F.col(c), F.lit(0))).over(w) for n, c in columns.items()})
    d = materialize(d, "prefix_blocks")
    totals = d.groupBy("_block").agg(*[F.max_by(f"_in_{n}", at).alias(f"_t_{n}") for n in columns])
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)       # one row a block
    totals = totals.select(F.col("_block").alias("_b"), *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in columns])
    out = d.join(totals, F.col("_block") == F.col("_b"))
    return out.select(*df.columns, *[(F.col(f"_in_{n}") + F.col(f"_o_{n}")).alias(n) for n in columns])
