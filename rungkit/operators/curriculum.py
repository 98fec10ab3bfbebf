"""Adaptive partial-solution curriculum as keyed Spark jobs.

Input is an attempts table ``(sample_id, step, pos, portion, reward, split)``
in arrival order ``(step, pos)``. The per-sample ledger, the step
contributions, the global moving-average bounds and the sampling policy
are window / aggregate jobs; what is sequential (runs of a sample, moving
averages) is a prefix scan over associative summaries of blocks.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rungkit.functions.hashing import uniform
from rungkit.operators.materialize import materialize
from rungkit.operators.ordering import assign_index


@dataclass(frozen=True)
class CurriculumConfig:
    min_ratio: float = 0.0
    max_ratio: float = 0.9
    reward_threshold: float = 0.5
    alpha: float = 0.8
    epsilon: float = 0.01       # sampling weight floor
    easy_floor: float = 0.02    # weight of solved-without-help samples


DEFAULT = CurriculumConfig()
UNBOUNDED = Window.unboundedPreceding


# ---------------------------------------------------------------- ledger (37)

def _local_runs(att: DataFrame, key: str) -> DataFrame:
    """Runs inside one (sample, step): work per task is one sample-step."""
    w = Window.partitionBy(key, "step").orderBy("pos")
    prev = F.lag("portion").over(w)
    chg = F.when(prev.isNull() | (prev != F.col("portion")), 1).otherwise(0)
    d = att.withColumn("_chg", chg)
    return d.select(*[c for c in d.columns if c != "_chg"],
                    (F.sum("_chg").over(w.rowsBetween(UNBOUNDED, 0)) - 1).cast("int").alias("local_run"))


def _step_summaries(seg: DataFrame, key: str) -> DataFrame:
    """One row per (sample, step): first and last portion, number of runs, and
    count and sum of the last run's part in the step.  These summaries are
    associative: a sample's history is their product in step order."""
    last = F.max_by(F.struct("portion", "n", "reward_sum"), "local_run")
    return (seg.groupBy(key, "step")
            .agg(F.min_by("portion", "local_run").alias("first_p"), last.alias("tail"), F.max("local_run").alias("top"))
            .select(key, "step", "first_p", F.col("tail.portion").alias("last_p"), (F.col("top") + 1).cast("bigint").alias("runs"),
                    F.col("tail.n").alias("tail_n"), F.col("tail.reward_sum").alias("tail_s")))


def _carries(summaries: DataFrame, key: str, prior: DataFrame | None) -> DataFrame:
    """What every (sample, step) finds when it begins: ``joins`` (its first run
    continues the one before), ``base`` (runs begun before it) and
    ``open_n`` / ``open_s`` (count and sum of the run that is open).

    A prefix scan over summary rows: at most one per training step and
    sample, however many attempts or changes of portion a step has.
    """
    s = summaries.withColumn("is_prior", F.lit(False))
    if prior is not None:
        p = prior.select(key, F.lit(None).cast(s.schema["step"].dataType).alias("step"), F.col("last_portion").alias("first_p"),
                         F.col("last_portion").alias("last_p"), F.lit(1).cast("bigint").alias("runs"),
                         F.col("run_n").alias("tail_n"), F.col("run_sum").alias("tail_s"), F.lit(True).alias("is_prior"))
        s = s.unionByName(p)
    w = Window.partitionBy(key).orderBy(F.desc("is_prior"), "step")
    before = F.lag("last_p").over(w)
    s = s.withColumn("joins", before.isNotNull() & (before == F.col("first_p")))
    # runs that begin here; those of the stored state were counted by it
    begun = F.when(F.col("is_prior"), 0).otherwise(F.col("runs") - F.col("joins").cast("bigint"))
    s = s.withColumns({"begun": begun, "fresh": ((F.col("runs") > 1) | ~F.col("joins")).cast("bigint")})
    s = s.withColumns({"base": F.sum("begun").over(w.rowsBetween(UNBOUNDED, 0)) - F.col("begun"),
                       "stretch": F.sum("fresh").over(w.rowsBetween(UNBOUNDED, 0))})
    # the open run: this step's part of it, and, if it began before, all since
    o = Window.partitionBy(key, "stretch").orderBy(F.desc("is_prior"), "step").rowsBetween(UNBOUNDED, 0)
    s = s.withColumns({"out_n": F.sum("tail_n").over(o), "out_s": F.sum("tail_s").over(o)})
    zero = F.lit(0)
    s = s.withColumns({"open_n": F.when(F.col("joins"), F.lag("out_n").over(w)).otherwise(zero),
                       "open_s": F.when(F.col("joins"), F.lag("out_s").over(w)).otherwise(zero.cast("double"))})
    return s.filter(~F.col("is_prior")).select(key, "step", "joins", "base", "open_n", "open_s", (F.col("runs") - 1).alias("top"))


def ledger_segments(att: DataFrame, key: str = "sample_id", prior: DataFrame | None = None) -> DataFrame:
    """One row per (sample, step, local run): its count and sum, a per-sample
    ``run_id``, the running ``cum_n`` / ``cum_s`` of its run at its end, and
    ``is_last_in_step``.

    Blocked prefix scan: runs are found inside each (sample, step) by a window
    whose partitions are one sample-step; a step is summed up in one row
    (first and last portion, runs, open run), the summaries of a sample are
    scanned in order, and what each step finds at its beginning is joined back
    to its runs.  A sample with a long history of changing portions is thus
    never in one task row by row, nor run by run.

    ``prior`` (key, last_portion, run_n, run_sum) carries state from earlier
    steps: a sample's first new run continues the stored one when the portions
    are equal.
    """
    d = _local_runs(att, key)
    seg = d.groupBy(key, "step", "local_run").agg(
        F.first("portion").alias("portion"),   # constant inside a run
        F.count(F.lit(1)).cast("bigint").alias("n"),
        F.sum("reward").alias("reward_sum"),
        F.min("pos").alias("first_pos"),
    )
    seg = materialize(seg, "run_segments")     # read for the summaries and for the join
    c = _carries(_step_summaries(seg, key), key, prior)
    c = c.select(F.col(key).alias("_k"), F.col("step").alias("_s"), "joins", "base", "open_n", "open_s", "top")
    out = seg.join(c, F.col(key).eqNullSafe(F.col("_k")) & F.col("step").eqNullSafe(F.col("_s"))).drop("_k", "_s")
    first = (F.col("local_run") == 0) & F.col("joins")
    return out.select(key, "step", "local_run", "portion", "n", "reward_sum", "first_pos",
                      (F.col("base") + F.col("local_run") + 1 - F.col("joins").cast("bigint")).cast("bigint").alias("run_id"),
                      (F.col("n") + F.when(first, F.col("open_n")).otherwise(0)).cast("bigint").alias("cum_n"),
                      (F.col("reward_sum") + F.when(first, F.col("open_s")).otherwise(0.0)).alias("cum_s"),
                      (F.col("local_run") == F.col("top")).alias("is_last_in_step"))


def attempt_ledger(att: DataFrame, key: str = "sample_id") -> DataFrame:
    """Per-sample ledger: one row per run of equal consecutive portions."""
    seg = ledger_segments(att, key)
    return seg.groupBy(key, "run_id").agg(
        F.first("portion").alias("portion"),
        F.sum("n").cast("bigint").alias("n_rewards"),
        F.sum("reward_sum").alias("reward_sum"),
        F.min("step").alias("first_step"),
        F.max("step").alias("last_step"),
    ).withColumn("mean_reward", F.col("reward_sum") / F.col("n_rewards"))


# ----------------------------------------------- contributions (38) and max (40)

def step_contribution(att: DataFrame, key: str = "sample_id", cfg: CurriculumConfig = DEFAULT,
                      prior: DataFrame | None = None) -> DataFrame:
    """Per touched (sample, step): the last run's running mean reward and the
    upper/lower terms it adds to the step's moving-average update.

    ``prior`` = per-sample state after earlier steps (key, last_portion,
    run_n, run_sum, max_per_sample_ratio): a continuing run starts from the
    stored count/sum and the cap starts from the stored cap. Folding steps
    in pieces with ``prior`` gives the same result as one pass.
    """
    seg = ledger_segments(att, key, prior)
    last = seg.filter("is_last_in_step").select(
        key, "step", "run_id", "portion", (F.col("cum_s") / F.col("cum_n")).alias("run_mean_reward"),
        F.col("cum_n").alias("run_n"), F.col("cum_s").alias("run_sum"))
    if prior is not None:
        caps = prior.select(F.col(key).alias("_k"), F.col("max_per_sample_ratio").alias("_pmax"))
        last = last.join(caps, F.col(key).eqNullSafe(F.col("_k")), "left").drop("_k")
    else:
        last = last.withColumn("_pmax", F.lit(None).cast("double"))
    ok = F.col("run_mean_reward") >= F.lit(cfg.reward_threshold)
    ws = Window.partitionBy(key).orderBy("step")
    max_before = F.coalesce(
        F.last(F.when(ok, F.col("portion")), ignorenulls=True).over(ws.rowsBetween(UNBOUNDED, -1)),
        F.col("_pmax"), F.lit(cfg.max_ratio))
    last = last.withColumns({"success": ok, "max_ratio_before": max_before}).drop("_pmax")
    return last.withColumns({
        "upper_term": F.when(ok, F.col("portion")).otherwise(F.col("max_ratio_before")),
        "lower_term": F.when(ok, F.lit(cfg.min_ratio)).otherwise(F.col("portion")),
        "max_ratio_after": F.when(ok, F.col("portion")).otherwise(F.col("max_ratio_before"))})


def max_ratio_state(att: DataFrame, key: str = "sample_id", cfg: CurriculumConfig = DEFAULT) -> DataFrame:
    """Current per-sample cap: portion of the latest successful run end, else max_ratio."""
    c = step_contribution(att, key, cfg)
    return c.groupBy(key).agg(
        F.coalesce(F.max_by(F.when(F.col("success"), F.col("portion")),
                            F.when(F.col("success"), F.col("step"))), F.lit(cfg.max_ratio)).alias("max_per_sample_ratio"),
        F.max("step").alias("last_step"))


# ------------------------------------------------------------- EMA bounds (39)

def step_sums(contrib: DataFrame) -> DataFrame:
    return contrib.groupBy("step").agg(
        F.count(F.lit(1)).cast("bigint").alias("n_touched"),
        F.sum("upper_term").alias("sum_upper"),
        F.sum("lower_term").alias("sum_lower"))


#: powers of alpha stay above e**-LOG_RANGE inside a block; e**-LOG_ZERO is zero in double precision
LOG_RANGE, LOG_ZERO = 345.0, 746.0


def ema_blocks(alpha: float) -> tuple[int, int]:
    """(steps of a block, blocks that a block's end still reaches)."""
    if alpha <= 0.0:
        return 1, 1
    if alpha >= 1.0:
        return 1 << 62, 1
    decay = -math.log(alpha)
    block = max(1, int(min(LOG_RANGE / decay, 1 << 62)))
    return block, math.ceil(LOG_ZERO / (block * decay)) + 1


def ema_scan(df: DataFrame, order: str, alpha: float, columns: dict[str, tuple[str, float]]) -> DataFrame:
    """``df`` with moving averages m = alpha m + (1 - alpha) x along the unique
    non-null integer ``order``: ``columns`` maps a new column to (its x, its start).

    Prefix scan over affine maps m -> A m + B.  Rows are numbered without a
    global sort and cut into blocks; the map of a block's rows up to each row
    is one running sum (of x over powers of alpha, which stay in range inside
    a block), a block's end follows from the maps of the few blocks before it
    that are not yet zero in double precision, and each row applies its map to
    what its block starts from.  One task holds a block's rows, or one row a
    block.
    """
    block, reach = ema_blocks(alpha)
    d = assign_index(df, order, out="_i")
    d = d.withColumns({"_b": F.expr(f"_i div {block}"), "_q": F.expr(f"_i % {block}").cast("double")})
    up = F.pow(F.lit(float(alpha)), F.col("_q")) if alpha > 0 else F.lit(1.0)
    w = Window.partitionBy("_b").orderBy("_q").rowsBetween(UNBOUNDED, 0)
    local = {f"_l_{c}": F.sum(F.lit(1.0 - alpha) * F.col(x) / up).over(w) * up for c, (x, _) in columns.items()}
    d = materialize(d.withColumns(local), "ema_blocks")
    ends = d.groupBy("_b").agg(*[F.max_by(f"_l_{c}", "_q").alias(f"_e_{c}") for c in columns])
    over = Window.orderBy("_b")                # one row a block
    whole = float(alpha) ** block if alpha < 1 else 1.0
    start = F.pow(F.lit(whole), F.col("_b").cast("double"))
    carry = []
    for c, (_, m0) in columns.items():
        terms = [F.lit(whole ** j) * F.coalesce(F.lag(f"_e_{c}", j + 1).over(over), F.lit(0.0)) for j in range(reach)]
        carry.append((sum(terms[1:], terms[0]) + start * F.lit(float(m0))).alias(f"_c_{c}"))
    carries = ends.select(F.col("_b").alias("_cb"), *carry)
    d = d.join(carries, F.col("_b") == F.col("_cb"))
    after = F.pow(F.lit(float(alpha)), F.col("_q") + 1)
    return d.select(*df.columns, *[(F.col(f"_l_{c}") + after * F.col(f"_c_{c}")).alias(c) for c in columns])


def ema_bounds(contrib: DataFrame, cfg: CurriculumConfig = DEFAULT, init: tuple | None = None) -> DataFrame:
    """Global moving-average bounds after every step that touched a sample
    (see :func:`ema_scan`). ``init`` = (mean_min, mean_max) after earlier
    steps, to continue incrementally."""
    lo0, hi0 = init if init is not None else (cfg.min_ratio, cfg.max_ratio)
    per_step = materialize(step_sums(contrib), "step_sums").withColumns({
        "_lo": F.col("sum_lower") / F.col("n_touched"), "_hi": F.col("sum_upper") / F.col("n_touched")})
    return ema_scan(per_step, "step", float(cfg.alpha), {"mean_min_ratio": ("_lo", lo0), "mean_max_ratio": ("_hi", hi0)}).select(
        F.col("step").cast("int").alias("step"), "n_touched", "sum_upper", "sum_lower", "mean_min_ratio", "mean_max_ratio")


def final_bounds(ema: DataFrame, cfg: CurriculumConfig = DEFAULT) -> DataFrame:
    """One-row table of the latest global bounds (initial values when no step)."""
    last = ema.agg(F.max_by(F.struct("mean_min_ratio", "mean_max_ratio"), "step").alias("m"))
    return last.select(
        F.coalesce(F.col("m.mean_min_ratio"), F.lit(cfg.min_ratio)).alias("mean_min_ratio"),
        F.coalesce(F.col("m.mean_max_ratio"), F.lit(cfg.max_ratio)).alias("mean_max_ratio"))


# --------------------------------------------------- per-sample state and policy

def sample_state(att_train: DataFrame, samples: DataFrame, key: str = "sample_id",
                 cfg: CurriculumConfig = DEFAULT) -> DataFrame:
    """Latest state per sample: last run (portion, mean), cap, plus global bounds.

    ``samples`` is the sample universe (ids without history included).
    """
    # read by two aggregations (per-sample state, per-step sums): written once
    c = materialize(step_contribution(att_train, key, cfg), "contributions")
    last = c.groupBy(key).agg(F.max_by(F.struct("portion", "run_mean_reward", "max_ratio_after", "step"),
                                       "step").alias("s"))
    last = last.select(key, F.col("s.portion").alias("last_portion"),
                       F.col("s.run_mean_reward").alias("last_mean_reward"),
                       F.col("s.max_ratio_after").alias("max_per_sample_ratio"),
                       F.col("s.step").alias("last_step"))
    bounds = final_bounds(ema_bounds(c, cfg), cfg)
    st = samples.select(key).distinct().join(last, key, "left")
    st = st.crossJoin(F.broadcast(bounds))   # one-row side
    return st.withColumn("max_per_sample_ratio", F.coalesce("max_per_sample_ratio", F.lit(cfg.max_ratio)))


def fold_state(contrib: DataFrame, key: str = "sample_id") -> DataFrame:
    """What a state has to keep of the samples ``contrib`` touches: the last
    run's portion, count and sum, the cap and the step; enough to go on from
    (``prior`` of :func:`step_contribution`)."""
    s = contrib.groupBy(key).agg(F.max_by(F.struct("portion", "run_n", "run_sum", "max_ratio_after", "step"), "step").alias("s"))
    return s.select(key, F.col("s.portion").alias("last_portion"), F.col("s.run_n").alias("run_n"), F.col("s.run_sum").alias("run_sum"),
                    F.col("s.max_ratio_after").alias("max_per_sample_ratio"), F.col("s.step").alias("last_step"))


def portion_bounds(state: DataFrame, cfg: CurriculumConfig = DEFAULT) -> DataFrame:
    """Bisection bounds for the next portion of every sample (op 35)."""
    has = F.col("last_portion").isNotNull()
    fail = F.col("last_mean_reward") < F.lit(cfg.reward_threshold)
    lo = F.when(~has, F.col("mean_min_ratio")).when(fail, F.col("last_portion")).otherwise(F.lit(0.0))
    hi = F.when(~has, F.col("mean_max_ratio")).when(fail, F.col("max_per_sample_ratio")) \
          .otherwise(F.col("last_portion"))
    return state.withColumn("lower_bound", lo).withColumn("upper_bound", hi)


def portion_seed(idx: Column, global_step) -> Column:
    """seed = global_step + 1024 * idx (op 34; collisions kept as in the rule)."""
    return (F.lit(global_step) if not isinstance(global_step, Column) else global_step) + F.lit(1024) * idx


def sample_portion(lo: Column, hi: Column, seed: Column, zero_prob=0.0) -> Column:
    """Draw a portion (op 36). Two hash uniforms u1 (gate) and u2 (value)."""
    u1 = uniform(seed, F.lit(1))
    u2 = uniform(seed, F.lit(2))
    lohi = lo + (hi - lo) * u2
    wide = F.lit(0.9) * u2
    if isinstance(zero_prob, str):
        if zero_prob == "linear":
            return F.when(u1 >= hi, F.lit(0.0)).otherwise(lohi)
        if zero_prob == "uniform":
            return wide
        if zero_prob == "uniform-linear":
            return F.when(u1 >= F.lit(0.5), F.lit(0.0)).otherwise(wide)
        raise ValueError(f"unknown zero_prob mode {zero_prob!r}")
    p = float(zero_prob)
    if p == 0.0:
        return lohi
    return F.when(u1 <= F.lit(p), F.lit(0.0)).otherwise(lohi)


def fixed_portion(df: DataFrame, portion, seed_col: Column | None = None) -> DataFrame:
    """Base dataset portion (op 33): a number, or a Column function of the seed."""
    if callable(portion):
        return df.withColumn("portion", portion(seed_col))
    if isinstance(portion, (int, float)) and not isinstance(portion, bool):
        return df.withColumn("portion", F.lit(float(portion)))
    raise ValueError("portion must be a number or a callable(seed) -> Column")


def dataset_portion(df: DataFrame, dataset_type: str, base=1.0, adaptive=None, seed_col: Column | None = None) -> DataFrame:
    """Portion policy by dataset type: ``base`` takes ``base`` (a number or a
    function of the seed), ``adaptive`` the function ``adaptive(df)``."""
    if dataset_type == "base":
        return fixed_portion(df, base, seed_col)
    if dataset_type == "adaptive":
        if adaptive is None:
            raise ValueError("an adaptive dataset needs its portion function")
        return adaptive(df)
    raise ValueError(f"dataset type must be 'base' or 'adaptive', not {dataset_type!r}")


def sampling_weights(state: DataFrame, cfg: CurriculumConfig = DEFAULT, weight_fn=None) -> DataFrame:
    """Sampler weights (op 41): harder and more-helped samples weigh more;
    ``weight_fn(state) -> Column`` replaces the rule."""
    if weight_fn is not None:
        return state.withColumn("weight", weight_fn(state))
    r, p = F.col("last_mean_reward"), F.col("last_portion")
    base = (F.lit(1.0) - r) + p
    easy = (r >= F.lit(0.99)) & (p <= F.lit(0.01))
    w = F.when(p.isNull(), F.lit(1.0)).otherwise(
        F.greatest(F.when(easy, F.lit(cfg.easy_floor)).otherwise(base), F.lit(cfg.epsilon)))
    return state.withColumn("weight", w)


def batch_portion_log(att: DataFrame, batch_cols=("step", "split")) -> DataFrame:
    """Mean and population std of portions per scored batch (op 43)."""
    return att.groupBy(*batch_cols).agg(
        F.count(F.lit(1)).cast("bigint").alias("n"),
        F.avg("portion").alias("portion_mean"),
        F.stddev_pop("portion").alias("portion_std"))
