"""Materialise an intermediate table that several branches consume.

The table is written as parquet under the shared folder named by
``spark.checkpoint.dir`` and read back: it is computed once, survives
executor loss (no recomputation from lineage) and cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from rungkit.session import scratch_path


def materialize(df: DataFrame, name: str) -> DataFrame:
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
