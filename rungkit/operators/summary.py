"""What a text rule did, by group: rows, hits, misses, answers, tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rule_summary(df: DataFrame, by, hit: Column, answer: Column | None = None, tokens: Column | None = None) -> DataFrame:
    """One row per group of ``by``: ``n_rows``, ``hits``, ``misses`` and, where
    given, ``distinct_answers`` and ``n_tokens`` (rewritten)."""
    ok = F.coalesce(hit, F.lit(False))
    out = [F.count(F.lit(1)).cast("bigint").alias("n_rows"), F.count(F.when(ok, 1)).cast("bigint").alias("hits"),
           F.count(F.when(~ok, 1)).cast("bigint").alias("misses")]
    if answer is not None:
        out.append(F.countDistinct(answer).cast("bigint").alias("distinct_answers"))
    if tokens is not None:
        out.append(F.sum(F.greatest(F.coalesce(tokens, F.lit(0)), F.lit(0))).cast("bigint").alias("n_tokens"))
    return df.groupBy(*by).agg(*out)


def misses(df: DataFrame, hit: Column) -> DataFrame:
    """Quarantine: the rows the rule could not serve."""
    return df.where(~F.coalesce(hit, F.lit(False)))
