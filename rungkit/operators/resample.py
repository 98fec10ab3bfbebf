"""Weighted sampling with replacement as an exact distributed range join (op 42).

Weights become fixed-point integers, so cumulative ranges are exact and
order-independent. Each draw scales a 60-bit hash onto ``[0, total)`` in
exact decimal arithmetic (every unit of weight can be drawn for totals up to
2**60, evenly up to one part in 2**60 / total) and finds the sample whose
range holds it. There are as many draws as rows; rows of weight zero are
never drawn, a positive weight below the resolution counts as one unit of it
(so that it can be drawn), a NULL or negative weight fails the job. The range join is an equi-join on
a block of the integer axis: a sample is listed once per block its range
touches (at most ``n_samples + n_blocks`` rows in all), a draw looks in
its one block, so neither side is broadcast and no block is hot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rungkit.operators.materialize import materialize
from rungkit.operators.ordering import key_bucket, prefix_offsets

SCALE = 1_000_000
HASH_BITS = 60


def weighted_resample(df: DataFrame, key: str, weight: str, seed=0) -> DataFrame:
    """N draws (N = number of rows) proportional to ``weight``; returns (draw_id, key)."""
    bad = F.raise_error(F.lit("weights must be numbers of at least 0"))
    whole = F.round(F.col(weight) * F.lit(SCALE)).cast("bigint")
    unit = F.when(F.col(weight) > 0, F.lit(1)).otherwise(F.lit(0))
    wi = F.when(F.col(weight) >= 0, F.greatest(whole, unit.cast("bigint"))).otherwise(bad.cast("bigint"))
    w = materialize(df.select(key, wi.alias("_wi")), "resample_weights")
    # one prefix pass: cumulative weight (range start) and rank (draw id), plus the total
    ranked = prefix_offsets(key_bucket(w, key), [key], F.col("_kb"), weight=F.col("_wi"), out="_lo",
                            extra={"_rank": F.lit(1)}, total_out="_total").drop("_kb")
    ranked = materialize(ranked, "resample_ranges")
    n = ranked.agg(F.count(F.lit(1)).alias("_n"))            # one row
    ranked = ranked.crossJoin(F.broadcast(n)) \
        .withColumn("_bw", F.greatest(F.lit(1), F.ceil(F.col("_total") / F.col("_n"))).cast("bigint"))
    # a sample is listed once per block its range touches: <= n_samples + n_blocks rows
    spans = ranked.filter(F.col("_wi") > 0).select(key, "_lo", "_wi", F.explode(F.sequence(
        F.floor(F.col("_lo") / F.col("_bw")).cast("bigint"),
        F.floor((F.col("_lo") + F.col("_wi") - 1) / F.col("_bw")).cast("bigint"))).alias("_blk"))
    ranked = ranked.withColumn("_h60", F.conv(F.substring(F.md5(F.concat_ws(
        ":", F.lit(str(seed)), F.col("_rank").cast("string"))), 1, 15), 16, 10).cast("decimal(19,0)"))
    target = F.expr(f"(_h60 * cast(_total as decimal(19,0))) div {2 ** HASH_BITS}")
    draws = ranked.select(F.col("_rank").alias("draw_id"), "_bw", target.alias("_t"))
    draws = draws.withColumn("_blk", F.floor(F.col("_t") / F.col("_bw")).cast("bigint"))
    hit = draws.join(spans, "_blk").filter((F.col("_t") >= F.col("_lo")) & (F.col("_t") < F.col("_lo") + F.col("_wi")))
    return hit.select("draw_id", key)
