"""Curriculum jobs vs a sequential pure-Python model of the same rules."""

import math

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from rungkit.functions.hashing import uniform
from rungkit.operators import curriculum as cur
from rungkit.sources import views as V

THR, MAXR, MINR, ALPHA = 0.5, 0.9, 0.0, 0.8


def sequential_model(attempts):
    """attempts: list of (step, pos, sample, portion, reward), train only."""
    hist, maxr = {}, {}
    lo, hi = MINR, MAXR
    per_step = []
    for step in sorted({a[0] for a in attempts}):
        touched = []
        for (_, _, sid, portion, reward) in sorted(a for a in attempts if a[0] == step):
            runs = hist.setdefault(sid, [])
            if not runs or runs[-1][0] != portion:
                runs.append([portion, [reward]])
            else:
                runs[-1][1].append(reward)
            if sid not in touched:
                touched.append(sid)
        up = low = 0.0
        for sid in touched:
            portion, rewards = hist[sid][-1]
            m = sum(rewards) / len(rewards)
            if m < THR:
                low += portion
                up += maxr.get(sid, MAXR)
            else:
                up += portion
                low += MINR
                maxr[sid] = portion
        lo = ALPHA * lo + (1 - ALPHA) * low / len(touched)
        hi = ALPHA * hi + (1 - ALPHA) * up / len(touched)
        per_step.append((step, len(touched), lo, hi))
    return hist, maxr, per_step


@pytest.fixture(scope="module")
def model_and_rows(spark):
    att = V.attempts_train(spark, SF_SMALL)
    rows = [(r.step, r.pos, r.sample_id, r.portion, r.reward) for r in att.collect()]
    return sequential_model(rows), att


def test_ledger_matches_model(model_and_rows):
    (hist, _, _), att = model_and_rows
    led = cur.attempt_ledger(att).collect()
    got = {}
    for r in led:
        got.setdefault(r.sample_id, {})[r.run_id] = (r.portion, r.n_rewards, r.reward_sum)
    for sid, runs in hist.items():
        assert len(got[sid]) == len(runs)
        for i, (portion, rewards) in enumerate(runs, start=1):
            assert got[sid][i] == (portion, len(rewards), sum(rewards))


def test_ema_matches_model(model_and_rows):
    (_, _, per_step), att = model_and_rows
    ema = {r.step: r for r in cur.ema_bounds(cur.step_contribution(att)).collect()}
    assert len(ema) == len(per_step)
    for step, n, lo, hi in per_step:
        assert ema[step].n_touched == n
        assert math.isclose(ema[step].mean_min_ratio, lo, abs_tol=1e-12)
        assert math.isclose(ema[step].mean_max_ratio, hi, abs_tol=1e-12)


def test_max_ratio_matches_model(model_and_rows):
    (_, maxr, _), att = model_and_rows
    got = {r.sample_id: r.max_per_sample_ratio for r in cur.max_ratio_state(att).collect()}
    for sid, v in got.items():
        assert v == maxr.get(sid, MAXR)


def _att(spark, rows):
    return spark.createDataFrame(rows, "step int, pos long, sample_id long, portion double, reward double")


def test_runs_span_steps_and_aba(spark):
    # same portion in consecutive steps -> one run; A, B, A -> three runs
    a = _att(spark, [(0, 1, 7, 0.3, 1.0), (1, 2, 7, 0.3, 0.0), (0, 3, 8, 0.1, 1.0), (0, 4, 8, 0.2, 1.0),
                     (1, 5, 8, 0.1, 0.0)])
    led = sorted((r.sample_id, r.run_id, r.portion, r.n_rewards) for r in cur.attempt_ledger(a).collect())
    assert led == [(7, 1, 0.3, 2), (8, 1, 0.1, 1), (8, 2, 0.2, 1), (8, 3, 0.1, 1)]


def test_step_contribution_order(spark):
    # fail then success in one step; success updates max only after its own upper term
    a = _att(spark, [(0, 1, 1, 0.5, 0.0), (1, 2, 1, 0.4, 1.0), (2, 3, 1, 0.2, 0.0)])
    c = {r.step: r for r in cur.step_contribution(a).collect()}
    assert (c[0].upper_term, c[0].lower_term) == (0.9, 0.5)
    assert (c[1].upper_term, c[1].lower_term, c[1].max_ratio_after) == (0.4, 0.0, 0.4)
    assert (c[2].upper_term, c[2].lower_term) == (0.4, 0.2)


def test_weights_table(spark):
    st = spark.createDataFrame([(1, None, None), (2, 1.0, 0.0), (3, 0.99, 0.01), (4, 1.0, 0.02), (5, 0.0, 0.9)],
                               "sample_id long, last_mean_reward double, last_portion double")
    w = {r.sample_id: r.weight for r in cur.sampling_weights(st).collect()}
    assert w[1] == 1.0 and w[2] == 0.02 and w[3] == 0.02 and math.isclose(w[4], 0.02) and w[5] == 1.9
    assert min(w.values()) >= 0.01


def test_bounds_rules(spark):
    st = spark.createDataFrame([(1, None, None, 0.9, 0.1, 0.8), (2, 0.4, 0.2, 0.7, 0.1, 0.8),
                                (3, 0.4, 0.9, 0.7, 0.1, 0.8)],
                               "sample_id long, last_portion double, last_mean_reward double, "
                               "max_per_sample_ratio double, mean_min_ratio double, mean_max_ratio double")
    b = {r.sample_id: (r.lower_bound, r.upper_bound) for r in cur.portion_bounds(st).collect()}
    assert b == {1: (0.1, 0.8), 2: (0.4, 0.7), 3: (0.0, 0.4)}
    assert all(lo <= hi for lo, hi in b.values())


def test_sample_portion_modes(spark):
    d = spark.createDataFrame([(s,) for s in range(200)], "seed long")
    lo, hi = F.lit(0.2), F.lit(0.6)
    out = d.select("seed", uniform(F.col("seed"), F.lit(1)).alias("u1"),
                   cur.sample_portion(lo, hi, F.col("seed"), 0.0).alias("z"),
                   cur.sample_portion(lo, hi, F.col("seed"), "linear").alias("lin"),
                   cur.sample_portion(lo, hi, F.col("seed"), "uniform").alias("uni"),
                   cur.sample_portion(lo, hi, F.col("seed"), "uniform-linear").alias("ul"),
                   cur.sample_portion(lo, hi, F.col("seed"), 0.3).alias("p")).collect()
    for r in out:
        assert 0.2 <= r.z < 0.6 and 0.0 <= r.uni < 0.9
        assert (r.lin == 0.0) == (r.u1 >= 0.6)
        assert (r.ul == 0.0) == (r.u1 >= 0.5)
        assert (r.p == 0.0) == (r.u1 <= 0.3)
    eq = spark.range(5).select(cur.sample_portion(F.lit(0.4), F.lit(0.4), F.col("id"), 0.0).alias("v")).collect()
    assert {r.v for r in eq} == {0.4}


def test_weighted_resample_exact(spark):
    from rungkit.operators.resample import SCALE, weighted_resample
    st = spark.createDataFrame([(i, w) for i, w in enumerate([1.0, 0.02, 1.9, 0.5, 1.0])],
                               "sample_id long, weight double")
    got = {r.draw_id: r.sample_id for r in weighted_resample(st, "sample_id", "weight", seed=3).collect()}
    assert sorted(got) == list(range(5))
    import hashlib
    wi = [round(w * SCALE) for w in [1.0, 0.02, 1.9, 0.5, 1.0]]
    cum = [sum(wi[:i]) for i in range(5)]
    for d in range(5):
        t = int(hashlib.md5(f"3:{d}".encode()).hexdigest()[:15], 16) * sum(wi) >> 60
        expect = max(i for i in range(5) if cum[i] <= t)
        assert got[d] == expect


def test_hot_sample_matches_model(spark):
    """One sample holds a third of all attempts, spread over many steps."""
    rows, pos = [], 0
    for step in range(40):
        for k in range(6):
            pos += 1
            rows.append((step, pos, 1, [0.1, 0.3, 0.5][(step // 3 + k // 4) % 3], float((pos * 7) % 3 == 0)))
        for sid in (2, 3, 4):
            pos += 1
            rows.append((step, pos, sid, 0.2 if step % 5 else 0.4, float((pos + sid) % 2)))
    assert sum(r[2] == 1 for r in rows) * 3 >= len(rows)
    _, maxr, per_step = sequential_model(rows)
    a = _att(spark, rows)
    ema = {r.step: r for r in cur.ema_bounds(cur.step_contribution(a)).collect()}
    for step, n, lo, hi in per_step:
        assert ema[step].n_touched == n
        assert math.isclose(ema[step].mean_max_ratio, hi, abs_tol=1e-12)
        assert math.isclose(ema[step].mean_min_ratio, lo, abs_tol=1e-12)


def test_incremental_fold_equals_one_pass(spark):
    """Folding steps in two pieces with carried state equals one pass."""
    a = V.attempts_train(spark, SF_SMALL)
    whole = {r.step: r for r in cur.step_contribution(a).collect()}
    first = cur.step_contribution(a.filter("step < 13"))
    state = first.groupBy("sample_id").agg(F.max_by(F.struct("portion", "run_n", "run_sum", "max_ratio_after"),
                                                    "step").alias("s")) \
        .select("sample_id", F.col("s.portion").alias("last_portion"), F.col("s.run_n").alias("run_n"),
                F.col("s.run_sum").alias("run_sum"), F.col("s.max_ratio_after").alias("max_per_sample_ratio"))
    second = cur.step_contribution(a.filter("step >= 13"), prior=state).collect()
    got = {(r.sample_id, r.step): (r.run_n, r.upper_term, r.lower_term) for r in first.collect() + second}
    exp = {}
    for r in cur.step_contribution(a).collect():
        exp[(r.sample_id, r.step)] = (r.run_n, r.upper_term, r.lower_term)
    assert got == exp and whole


@pytest.mark.parametrize("parts", [3, 17])
def test_ledger_invariant_to_shuffle_partitions(spark, parts):
    a = V.attempts_train(spark, SF_SMALL)
    base = sorted(map(tuple, cur.attempt_ledger(a).collect()))
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        assert sorted(map(tuple, cur.attempt_ledger(a.repartition(parts)).collect())) == base
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
