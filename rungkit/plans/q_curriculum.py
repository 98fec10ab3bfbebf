"""Curriculum queries over the ``attempts`` view (ops 33-44)."""

from __future__ import annotations

from pyspark.sql import functions as F

from rungkit.operators import curriculum as cur
from rungkit.operators.ordering import prefix_offsets
from rungkit.operators.resample import weighted_resample
from rungkit.plans.registry import register
from rungkit.sources import views as V

NEXT_STEP = 30      # global step at which the next portions are drawn
A = 0.8
B = repr(1.0 - A)

# ---- shared oracle fragments (plain window formulation over the whole history)
_RUNS = """
flagged AS (
  SELECT *, CASE WHEN lag(portion) OVER w IS NULL OR lag(portion) OVER w <> portion THEN 1 ELSE 0 END AS chg
  FROM attempts_train WINDOW w AS (PARTITION BY sample_id ORDER BY step, pos)),
runs AS (
  SELECT *, CAST(sum(chg) OVER (PARTITION BY sample_id ORDER BY step, pos ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run_id
  FROM flagged)"""
_CONTRIB = _RUNS + """,
last_run AS (SELECT sample_id, step, max(run_id) AS run_id FROM runs GROUP BY sample_id, step),
contrib0 AS (
  SELECT l.sample_id, l.step, l.run_id, min(r.portion) AS portion,
         sum(r.reward) / count(*) AS run_mean_reward, count(*) AS run_n
  FROM last_run l JOIN runs r ON r.sample_id = l.sample_id AND r.run_id = l.run_id AND r.step <= l.step
  GROUP BY l.sample_id, l.step, l.run_id),
contrib AS (
  SELECT *, run_mean_reward >= 0.5 AS success,
         coalesce(last_value(CASE WHEN run_mean_reward >= 0.5 THEN portion END IGNORE NULLS)
                  OVER (PARTITION BY sample_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.9)
           AS max_ratio_before
  FROM contrib0),
terms AS (
  SELECT *, CASE WHEN success THEN portion ELSE max_ratio_before END AS upper_term,
            CASE WHEN success THEN 0.0 ELSE portion END AS lower_term,
            CASE WHEN success THEN portion ELSE max_ratio_before END AS max_ratio_after
  FROM contrib)"""
_EMA = _CONTRIB + f""",
sums AS (
  SELECT step, count(*) AS n_touched, sum(upper_term) AS sum_upper, sum(lower_term) AS sum_lower,
         row_number() OVER (ORDER BY step) AS rn
  FROM terms GROUP BY step),
ema(rn, step, n_touched, sum_upper, sum_lower, lo, hi) AS (
  SELECT 0, NULL::BIGINT, NULL::BIGINT, NULL::DOUBLE, NULL::DOUBLE, 0.0::DOUBLE, 0.9::DOUBLE
  UNION ALL
  SELECT s.rn, s.step, s.n_touched, s.sum_upper, s.sum_lower,
         {A} * e.lo + {B} * (s.sum_lower / s.n_touched),
         {A} * e.hi + {B} * (s.sum_upper / s.n_touched)
  FROM ema e JOIN sums s ON s.rn = e.rn + 1)"""
_STATE = _EMA + """,
final AS (SELECT coalesce(max_by(lo, rn), 0.0) AS mean_min_ratio, coalesce(max_by(hi, rn), 0.9) AS mean_max_ratio FROM ema),
last_state AS (
  SELECT sample_id, max_by(portion, step) AS last_portion, max_by(run_mean_reward, step) AS last_mean_reward,
         max_by(max_ratio_after, step) AS max_per_sample_ratio
  FROM terms GROUP BY sample_id),
state AS (
  SELECT u.sample_id, s.last_portion, s.last_mean_reward, coalesce(s.max_per_sample_ratio, 0.9) AS max_per_sample_ratio,
         f.mean_min_ratio, f.mean_max_ratio
  FROM (SELECT DISTINCT sample_id FROM attempts) u LEFT JOIN last_state s USING (sample_id) CROSS JOIN final f),
bounds AS (
  SELECT *,
    CASE WHEN last_portion IS NULL THEN mean_min_ratio WHEN last_mean_reward < 0.5 THEN last_portion ELSE 0.0 END AS lower_bound,
    CASE WHEN last_portion IS NULL THEN mean_max_ratio WHEN last_mean_reward < 0.5 THEN max_per_sample_ratio
         ELSE last_portion END AS upper_bound
  FROM state),
weights AS (
  SELECT *, CASE WHEN last_portion IS NULL THEN 1.0
                 ELSE greatest(CASE WHEN last_mean_reward >= 0.99 AND last_portion <= 0.01 THEN 0.02
                                    ELSE (1.0 - last_mean_reward) + last_portion END, 0.01) END AS weight
  FROM bounds)"""


def _rec(names, body):
    return V.with_views(names, body).replace("WITH ", "WITH RECURSIVE ", 1)


def _u(seed_expr, draw):
    return f"(('0x' || substr(md5(CAST({seed_expr} AS VARCHAR) || ':{draw}'), 1, 8))::BIGINT / 4294967296.0)"


@register("attempt_ledger", V.with_views(["attempts_train"], "," + _RUNS.lstrip() + """
SELECT sample_id, run_id, min(portion) AS portion, count(*) AS n_rewards, sum(reward) AS reward_sum,
       round(sum(reward) / count(*), 9) AS mean_reward, min(step) AS first_step, max(step) AS last_step
FROM runs GROUP BY sample_id, run_id"""))
def q_attempt_ledger(spark, sf):
    return cur.attempt_ledger(V.attempts_train(spark, sf))


@register("step_contribution", V.with_views(["attempts_train"], "," + _CONTRIB.lstrip() + """
SELECT sample_id, step, run_id, portion, round(run_mean_reward, 9) AS run_mean_reward, run_n,
       CAST(success AS BIGINT) AS success, max_ratio_before, upper_term, lower_term, max_ratio_after
FROM terms"""))
def q_step_contribution(spark, sf):
    c = cur.step_contribution(V.attempts_train(spark, sf))
    return c.select("sample_id", "step", "run_id", "portion", "run_mean_reward", "run_n", "success",
                    "max_ratio_before", "upper_term", "lower_term", "max_ratio_after")


@register("ema_bounds", _rec(["attempts_train"], "," + _EMA.lstrip() + """
SELECT step, n_touched, round(sum_upper, 9) AS sum_upper, round(sum_lower, 9) AS sum_lower,
       round(lo, 9) AS mean_min_ratio, round(hi, 9) AS mean_max_ratio
FROM ema WHERE rn > 0"""))
def q_ema_bounds(spark, sf):
    return cur.ema_bounds(cur.step_contribution(V.attempts_train(spark, sf)))


@register("max_ratio_state", V.with_views(["attempts_train"], "," + _CONTRIB.lstrip() + """
SELECT sample_id, max_by(max_ratio_after, step) AS max_per_sample_ratio, max(step) AS last_step
FROM terms GROUP BY sample_id"""))
def q_max_ratio_state(spark, sf):
    return cur.max_ratio_state(V.attempts_train(spark, sf))


def _state(spark, sf):
    att = V.attempts(spark, sf)
    return cur.sample_state(att.filter(F.col("split") == "train"), att)


@register("portion_bounds", _rec(["attempts_train"], "," + _STATE.lstrip() + """
SELECT sample_id, round(lower_bound, 9) AS lower_bound, round(upper_bound, 9) AS upper_bound FROM bounds"""))
def q_portion_bounds(spark, sf):
    return cur.portion_bounds(_state(spark, sf)).select("sample_id", "lower_bound", "upper_bound")


def _portion_cols(seed):
    lo, hi = F.col("lower_bound"), F.col("upper_bound")
    return [cur.sample_portion(lo, hi, seed, 0.0).alias("p_zero"),
            cur.sample_portion(lo, hi, seed, "linear").alias("p_linear"),
            cur.sample_portion(lo, hi, seed, "uniform").alias("p_uniform"),
            cur.sample_portion(lo, hi, seed, "uniform-linear").alias("p_uniform_linear"),
            cur.sample_portion(lo, hi, seed, 0.3).alias("p_prob")]


_SEED = f"({NEXT_STEP} + 1024 * sample_id)"


@register("sample_portion", _rec(["attempts_train"], "," + _STATE.lstrip() + f"""
SELECT sample_id, {_SEED} AS seed,
  round(lower_bound + (upper_bound - lower_bound) * {_u(_SEED, 2)}, 9) AS p_zero,
  round(CASE WHEN {_u(_SEED, 1)} >= upper_bound THEN 0.0
             ELSE lower_bound + (upper_bound - lower_bound) * {_u(_SEED, 2)} END, 9) AS p_linear,
  round(0.9 * {_u(_SEED, 2)}, 9) AS p_uniform,
  round(CASE WHEN {_u(_SEED, 1)} >= 0.5 THEN 0.0 ELSE 0.9 * {_u(_SEED, 2)} END, 9) AS p_uniform_linear,
  round(CASE WHEN {_u(_SEED, 1)} <= 0.3 THEN 0.0
             ELSE lower_bound + (upper_bound - lower_bound) * {_u(_SEED, 2)} END, 9) AS p_prob
FROM bounds"""))
def q_sample_portion(spark, sf):
    b = cur.portion_bounds(_state(spark, sf))
    seed = cur.portion_seed(F.col("sample_id"), NEXT_STEP)
    return b.select("sample_id", seed.alias("seed"), *_portion_cols(seed))


@register("portion_seed", V.with_views(["attempts"], """
SELECT sample_id, step, s AS seed, count(*) OVER (PARTITION BY s) AS n_sharing
FROM (SELECT DISTINCT sample_id, step, step + 1024 * sample_id AS s FROM attempts)"""))
def q_portion_seed(spark, sf):
    """Seed per (sample, step) and how many (sample, step) pairs share it."""
    from pyspark.sql import Window
    d = V.attempts(spark, sf).select("sample_id", "step").distinct()
    d = d.withColumn("seed", cur.portion_seed(F.col("sample_id"), F.col("step")))
    return d.withColumn("n_sharing", F.count(F.lit(1)).over(Window.partitionBy("seed")))


@register("fixed_portion", V.with_views(["attempts"], f"""
SELECT DISTINCT sample_id, 0.25::DOUBLE AS portion_const,
       round(0.5 * {_u(_SEED, 2)}, 9) AS portion_fn
FROM attempts"""))
def q_fixed_portion(spark, sf):
    from rungkit.functions.hashing import uniform
    s = V.attempts(spark, sf).select("sample_id").distinct()
    seed = cur.portion_seed(F.col("sample_id"), NEXT_STEP)
    a = cur.fixed_portion(s, 0.25).withColumnRenamed("portion", "portion_const")
    return cur.fixed_portion(a, lambda sd: F.lit(0.5) * uniform(sd, F.lit(2)), seed) \
              .withColumnRenamed("portion", "portion_fn")


@register("sampling_weights", _rec(["attempts_train"], "," + _STATE.lstrip() + """
SELECT sample_id, round(weight, 9) AS weight FROM weights"""))
def q_sampling_weights(spark, sf):
    return cur.sampling_weights(_state(spark, sf)).select("sample_id", "weight")


@register("curriculum_update", _rec(["attempts_train"], "," + _STATE.lstrip() + f"""
SELECT sample_id, round(lower_bound, 9) AS lower_bound, round(upper_bound, 9) AS upper_bound,
  round(CASE WHEN {_u(_SEED, 1)} >= upper_bound THEN 0.0
             ELSE lower_bound + (upper_bound - lower_bound) * {_u(_SEED, 2)} END, 9) AS next_portion,
  round(weight, 9) AS weight, round(max_per_sample_ratio, 9) AS max_per_sample_ratio,
  round(mean_min_ratio, 9) AS mean_min_ratio, round(mean_max_ratio, 9) AS mean_max_ratio
FROM weights"""))
def q_curriculum_update(spark, sf):
    """Whole batch loop: ledger -> contributions -> EMA -> bounds -> next portion + weight."""
    st = cur.sampling_weights(cur.portion_bounds(_state(spark, sf)))
    seed = cur.portion_seed(F.col("sample_id"), NEXT_STEP)
    nxt = cur.sample_portion(F.col("lower_bound"), F.col("upper_bound"), seed, "linear")
    return st.select("sample_id", "lower_bound", "upper_bound", nxt.alias("next_portion"), "weight",
                     "max_per_sample_ratio", "mean_min_ratio", "mean_max_ratio")


@register("batch_portion_log", V.with_views(["attempts"], """
SELECT step, split, count(*) AS n, round(avg(portion), 9) AS portion_mean,
       round(stddev_pop(portion), 9) AS portion_std
FROM attempts GROUP BY step, split"""))
def q_batch_portion_log(spark, sf):
    return cur.batch_portion_log(V.attempts(spark, sf))


@register("weighted_resample", _rec(["attempts_train"], "," + _STATE.lstrip() + """,
w AS (SELECT sample_id, CAST(round(weight * 1000000) AS BIGINT) AS wi FROM weights),
cum AS (SELECT sample_id, wi, sum(wi) OVER (ORDER BY sample_id ROWS UNBOUNDED PRECEDING) - wi AS lo FROM w),
tot AS (SELECT sum(wi) AS total, count(*) AS n FROM w),
draws AS (SELECT row_number() OVER (ORDER BY sample_id) - 1 AS draw_id FROM w),
tgt AS (SELECT draw_id, ((('0x' || substr(md5('7:' || CAST(draw_id AS VARCHAR)), 1, 8))::HUGEINT * 268435456
                         + ('0x' || substr(md5('7:' || CAST(draw_id AS VARCHAR)), 9, 7))::HUGEINT) * total::HUGEINT)
                         // 1152921504606846976::HUGEINT AS target
        FROM draws CROSS JOIN tot)
SELECT t.draw_id, c.sample_id FROM tgt t JOIN cum c ON t.target >= c.lo AND t.target < c.lo + c.wi"""))
def q_weighted_resample(spark, sf):
    st = cur.sampling_weights(_state(spark, sf))
    return weighted_resample(st, "sample_id", "weight", seed=7)
