"""Driver tables: one parquet file per table under an ``sf`` folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()

# fact tables whose rows carry per-row work, with the key they are spread by
FACT_KEYS = {"documents": "doc_id", "events": "event_id", "lineitem": "l_orderkey", "orders": "o_orderkey",
             "conversations": "conv_id", "pages": "page_id", "embeddings": "vec_id"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read a driver table.

    Scan parallelism floor: a fact table stored as a few large row groups
    would be scanned (and all per-row work before the first shuffle run)
    by a handful of tasks; such a scan is spread by its key over the
    default parallelism. On a cluster, inputs have far more splits than
    cores and this is a no-op.
    """
    if name not in TABLES:
        raise KeyError(name)
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    df = spark.read.parquet(path)
    key = FACT_KEYS.get(name)
    if key is not None:
        par = spark.sparkContext.defaultParallelism
        if df.rdd.getNumPartitions() < par:
            df = df.repartition(par, key)
    return df
