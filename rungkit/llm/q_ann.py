"""Query of the nearest-neighbour operator."""

from __future__ import annotations

from pyspark.sql import functions as F

from rungkit.llm.ann import nearest_neighbours
from rungkit.llm.common import query, read

QUERY_EVERY = 50


@query("op2_nearest_neighbours")
def op2_nearest_neighbours(spark, sf_dir):
    out = nearest_neighbours(read(spark, sf_dir, "embeddings"), "vec_id", "embedding",
                             F.col("c0") % QUERY_EVERY == 0, k=5)
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "score")
