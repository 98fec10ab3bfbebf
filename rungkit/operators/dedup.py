"""Keep-first deduplication by prompt (ops 25, 26).

The first position of each prompt is a hash aggregate over the prompt's
digest (one small row per key and map task, however often a prompt occurs);
rows then stay if they hold that position.  No prompt text is sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def prompt_key(df: DataFrame, prompt: str = "prompt", mode: str = "first_message") -> Column:
    """First message content for chat prompts (else the whole value as text)."""
    dtype = df.schema[prompt].dataType
    if isinstance(dtype, T.ArrayType) and isinstance(dtype.elementType, T.StructType):
        first = F.try_element_at(F.col(prompt), F.lit(1))["content"]
        whole = F.to_json(F.col(prompt))
        if mode == "all_messages":
            return whole
        return F.when(F.size(prompt) > 0, F.coalesce(first, whole)).otherwise(whole)
    return F.col(prompt).cast("string")


def dedup_first(df: DataFrame, order: str, prompt: str = "prompt", mode: str = "first_message") -> DataFrame:
    """First row of every prompt by ``order`` (a unique column); rows without
    a prompt are one group."""
    k = df.withColumn("_k", F.coalesce(F.sha2(prompt_key(df, prompt, mode), 256), F.lit("")))
    first = k.groupBy("_k").agg(F.min(order).alias("_first")).select(F.col("_k").alias("_k1"), "_first")
    return k.join(first, (k["_k"] == first["_k1"]) & (k[order] == first["_first"]), "left_semi").drop("_k")


def dedup_report(original: DataFrame, kept: DataFrame) -> DataFrame:
    """Rows before and after, of two tables that are there anyway; where only
    the counts are wanted, :func:`dedup_counts` reads the input once."""
    o = original.agg(F.count(F.lit(1)).cast("bigint").alias("original"))
    return _reduction(o.crossJoin(kept.agg(F.count(F.lit(1)).cast("bigint").alias("kept"))))      # one row each


def _reduction(r: DataFrame) -> DataFrame:
    r = r.withColumn("removed", F.col("original") - F.col("kept"))
    return r.withColumn("reduction_pct", F.round(F.col("removed") * 100.0 / F.nullif(F.col("original"), F.lit(0)), 2))


def dedup_counts(df: DataFrame, prompt: str = "prompt", mode: str = "first_message") -> DataFrame:
    """Rows, rows that stay (one per prompt) and what goes, in one pass: keys
    are counted, then one row per key is summed up."""
    k = F.coalesce(F.sha2(prompt_key(df, prompt, mode), 256), F.lit(""))
    per = df.select(k.alias("_k")).groupBy("_k").agg(F.count(F.lit(1)).alias("_n"))
    return _reduction(per.agg(F.coalesce(F.sum("_n"), F.lit(0)).cast("bigint").alias("original"),
                              F.count(F.lit(1)).cast("bigint").alias("kept")))
