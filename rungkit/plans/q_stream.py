"""Streaming curriculum query: replay attempts as arriving files (op 45)."""

from __future__ import annotations

from pyspark.sql import functions as F

from rungkit.plans.q_curriculum import _EMA, _rec
from rungkit.plans.registry import register
from rungkit.session import scratch_path
from rungkit.sources import views as V
from rungkit.streaming.curriculum_stream import (StreamPaths, as_stream_rows, incremental_ema, incremental_update,
                                                 late_attempts, run_until_idle)

# arrival plan: files cut at step edges, one cut inside a step, then a late file
CUTS = [
    "step < 10",
    "(step >= 10 AND step < 15) OR (step = 15 AND pos % 2 = 0)",
    "(step = 15 AND pos % 2 = 1) OR (step > 15 AND step < 20)",
    "step >= 20",
]
LATE = "step = 2 AND pos % 50 = 0"


@register("curriculum_stream", _rec(["attempts_train"], "," + _EMA.lstrip() + """
SELECT step, n_touched, round(sum_upper, 9) AS sum_upper, round(sum_lower, 9) AS sum_lower,
       round(lo, 9) AS mean_min_ratio, round(hi, 9) AS mean_max_ratio
FROM ema WHERE rn > 0 AND step < (SELECT max(step) FROM attempts_train)"""))
def q_curriculum_stream(spark, sf):
    """Attempts replayed as 4 ordered arrivals (+1 late file), each processed
    by an availableNow run from the same checkpoint and folded into the
    versioned state; moving-average bounds of every closed step."""
    paths, state = _replayed(spark, sf, fold=True)
    return incremental_ema(spark, state)


def _replayed(spark, sf, fold: bool):
    """(paths, state root) after all arrivals."""
    att = as_stream_rows(V.attempts(spark, sf))
    root = scratch_path(spark, "stream")
    paths = StreamPaths(f"{root}/source", f"{root}/closed", f"{root}/ckpt")
    late = att.filter(LATE).withColumn("pos", F.col("pos") + F.lit(10 ** 9))
    for arrival in [*map(att.filter, CUTS), late]:
        arrival.write.mode("append").parquet(paths.source)
        run_until_idle(spark, paths)
        if fold:
            incremental_update(spark, paths, f"{root}/state")
    return paths, f"{root}/state"


@register("curriculum_stream_late", V.with_views(["attempts"], """
SELECT sample_id, step, pos + 1000000000 AS pos, portion, reward, split FROM attempts WHERE step = 2 AND pos % 50 = 0"""))
def q_curriculum_stream_late(spark, sf):
    """Late side of the stream: attempts that arrived after their step closed."""
    paths, _ = _replayed(spark, sf, fold=False)
    return late_attempts(spark, paths).select("sample_id", "step", "pos", "portion", "reward", "split")
