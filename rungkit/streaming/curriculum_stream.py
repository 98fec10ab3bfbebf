"""Incremental curriculum updates with Structured Streaming (op 45).

Stage 1 is a native stateful aggregation (no Python callback): attempts
are grouped by (training-step window, sample) under a watermark and
emitted in append mode only once the watermark has passed the step, which
is exactly the per-step barrier of the online loop. Late attempts of an
already closed step are dropped by the watermark and counted in the
query progress.

Stage 2 folds only the newly closed steps into a versioned state (per
sample: last portion, its run's count and sum, cap -- O(1) per sample;
global: moving-average bounds), reading new steps by partition pruning.
The result equals the batch update over the same steps.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rungkit.operators import curriculum as cur
from rungkit.operators.materialize import materialize
from rungkit.sources.io import complete_steps, latest_step, state_base, state_restore, state_snapshot

ATTEMPT_SCHEMA = T.StructType([
    T.StructField("sample_id", T.LongType()),
    T.StructField("step", T.IntegerType()),
    T.StructField("pos", T.LongType()),
    T.StructField("portion", T.DoubleType()),
    T.StructField("reward", T.DoubleType()),
    T.StructField("split", T.StringType()),
    T.StructField("ts", T.TimestampType()),
])


@dataclass
class StreamPaths:
    source: str       # folder new attempt files land in
    sink: str         # closed (step, sample) groups, parquet
    checkpoint: str   # streaming checkpoint (restart point)


def closed_steps_query(spark: SparkSession, paths: StreamPaths, step_length: str = "1 day",
                       delay: str = "0 seconds", max_files_per_trigger: int | None = None):
    """Start stage 1 with an availableNow trigger; returns the StreamingQuery.

    By default everything that has arrived is one micro-batch, so the
    watermark only moves between arrivals: the files of one arrival may
    be read in any order without making each other late.
    """
    reader = spark.readStream.schema(ATTEMPT_SCHEMA)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    src = reader.parquet(paths.source)
    agg = (src.withWatermark("ts", delay)
           .groupBy(F.window("ts", step_length).alias("w"), "sample_id")
           .agg(F.array_sort(F.collect_list(F.struct("step", "pos", "portion", "reward", "split"))).alias("attempts")))
    out = agg.select(F.col("w.start").alias("window_start"), F.col("attempts")[0]["step"].alias("step"),
                     "sample_id", "attempts")
    # partitioned by step: the incremental update reads only new steps
    return (out.writeStream.outputMode("append").format("parquet").partitionBy("step")
            .option("path", paths.sink).option("checkpointLocation", paths.checkpoint)
            .trigger(availableNow=True).start())


def run_until_idle(spark: SparkSession, paths: StreamPaths, **kw) -> int:
    """Process everything available, from the checkpoint; returns rows
    dropped by the watermark in this run."""
    # keep every progress object of the run (100 by default)
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", 1_000_000)
    q = closed_steps_query(spark, paths, **kw)
    q.awaitTermination()
    dropped = 0
    for p in q.recentProgress:
        ops = p.get("stateOperators", []) if isinstance(p, dict) else (p.stateOperators or [])
        for s in ops:
            n = s.get("numRowsDroppedByWatermark", 0) if isinstance(s, dict) else s.numRowsDroppedByWatermark
            dropped += int(n or 0)
    return dropped


def closed_attempts(spark: SparkSession, paths: StreamPaths, after_step: int | None = None) -> DataFrame:
    """Attempt rows of closed steps (all, or those after ``after_step``),
    read from the stage-1 sink with partition pruning on ``step``."""
    s = spark.read.parquet(paths.sink)
    if after_step is not None:
        s = s.filter(F.col("step") > F.lit(after_step))
    return s.select("sample_id", F.explode("attempts").alias("a")).select(
        "sample_id", "a.step", "a.pos", "a.portion", "a.reward", "a.split")


COMPACT_EVERY = 16      # versions after which every sample is written again


def advance(new: DataFrame, state_root: str, cfg=cur.DEFAULT, key: str = "sample_id",
            compact_every: int = COMPACT_EVERY) -> int | None:
    """Fold attempts of later steps (training split) into the state at
    ``state_root``; the same as one pass over all of them.

    State = per-sample (last portion, its run's count and reward sum, cap)
    -- O(1) per sample, never the history -- plus the global bounds. A version
    holds only the samples it touches (a delta) and its moving-average rows;
    every ``compact_every``-th writes all samples. It counts once its manifest
    is there: what an interrupted run left is overwritten or never read.
    Returns the last folded step.
    """
    spark = new.sparkSession
    last = latest_step(spark, state_root)
    top = new.agg(F.max("step")).first()[0]
    if top is None:
        return last
    prior, init, base, deltas = None, None, None, []
    if last is not None:
        prior, glob, _ = state_restore(spark, state_root, last, key)
        g = glob.first()
        init = (g["mean_min_ratio"], g["mean_max_ratio"])
        base, deltas = state_base(spark, state_root, last)
        touched = new.select(F.col(key).alias("_k")).distinct()      # of the others nothing is read
        prior = materialize(prior.join(touched, F.col(key) == F.col("_k"), "left_semi"), "stream_prior")
    train = new.filter(F.col("split") == "train")
    c = materialize(cur.step_contribution(train, key, cfg, prior=prior), "stream_contrib")
    ema_path = f"{state_root.rstrip('/')}/step={int(top)}/ema"
    cur.ema_bounds(c, cfg, init).write.mode("overwrite").parquet(ema_path)
    ema = spark.read.parquet(ema_path)
    lo0, hi0 = init if init is not None else (cfg.min_ratio, cfg.max_ratio)
    glob = ema.agg(F.max_by(F.struct("mean_min_ratio", "mean_max_ratio"), "step").alias("m")).select(
        F.coalesce(F.col("m.mean_min_ratio"), F.lit(float(lo0))).alias("mean_min_ratio"),
        F.coalesce(F.col("m.mean_max_ratio"), F.lit(float(hi0))).alias("mean_max_ratio"))
    samples = cur.fold_state(c, key)
    if base is not None and len(deltas) + 1 >= compact_every:
        whole, _, _ = state_restore(spark, state_root, last, key)
        old = whole.join(samples.select(F.col(key).alias("_k")), F.col(key) == F.col("_k"), "left_anti")
        samples, base = old.unionByName(samples), None
    state_snapshot(samples, glob, state_root, int(top), base)
    return int(top)


def incremental_update(spark: SparkSession, paths: StreamPaths, state_root: str, cfg=cur.DEFAULT,
                       key: str = "sample_id") -> int | None:
    """Fold the steps closed since the last state version into a new one
    (see :func:`advance`)."""
    return advance(closed_attempts(spark, paths, latest_step(spark, state_root)), state_root, cfg, key)


def incremental_ema(spark: SparkSession, state_root: str) -> DataFrame:
    """All moving-average rows folded so far (one per closed training step),
    from complete versions only."""
    root = state_root.rstrip("/")
    return spark.read.parquet(*[f"{root}/step={s}/ema" for s in complete_steps(spark, root)])


def late_attempts(spark: SparkSession, paths: StreamPaths) -> DataFrame:
    """Attempts of closed steps that came too late to be counted in them."""
    closed = closed_attempts(spark, paths)
    steps = closed.agg(F.max("step").alias("top"))
    src = spark.read.schema(ATTEMPT_SCHEMA).parquet(paths.source)
    cols = ["sample_id", "step", "pos", "portion", "reward", "split"]
    same = [src[c].eqNullSafe(closed[c]) for c in cols]
    cond = same[0]
    for c in same[1:]:
        cond = cond & c
    return src.join(F.broadcast(steps), F.col("step") <= F.col("top")).drop("top").join(closed, cond, "left_anti")


def stream_ema_bounds(spark: SparkSession, paths: StreamPaths, cfg=cur.DEFAULT) -> DataFrame:
    """Stage 2: moving-average bounds after every closed step."""
    att = closed_attempts(spark, paths).filter(F.col("split") == "train")
    return cur.ema_bounds(cur.step_contribution(att, "sample_id", cfg), cfg)


def stream_sample_state(spark: SparkSession, paths: StreamPaths, cfg=cur.DEFAULT) -> DataFrame:
    att = closed_attempts(spark, paths)
    return cur.sample_state(att.filter(F.col("split") == "train"), att, "sample_id", cfg)


def as_stream_rows(att: DataFrame) -> DataFrame:
    """Attempts view rows in the stream schema (event time as a timestamp)."""
    return att.select("sample_id", F.col("step").cast("int"), "pos", "portion", "reward", "split",
                      F.col("ts").cast("timestamp").alias("ts"))
