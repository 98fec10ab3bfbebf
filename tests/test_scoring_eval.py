"""Scorers, pass@k and trajectory statistics."""

import math

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from rungkit.functions import scoring as sc
from rungkit.operators import curriculum as cur
from rungkit.operators import evaluate as ev
from rungkit.sources import views as V


def score(spark, fn, pairs):
    df = spark.createDataFrame([(i, s, t) for i, (s, t) in enumerate(pairs)], "i int, s string, t string")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("s"), F.col("t"))).collect()]


def test_parity_table(spark):
    got = score(spark, sc.score_parity, [("1 0", "1 0"), ("0 1", "1 0"), ("1 1", "1 0"), ("1 1 1", "1 0"),
                                         ("1 0 1", "1 0"), ("1", "1 0"), ("a b", "1 0"), (None, "1 0")])
    assert got == [1.0, 1.0, 0.1, 0.0, 0.9, 0.0, 0.0, 0.0]


def test_parity_malformed_truth_is_null(spark):
    assert score(spark, sc.score_parity, [("1 0", "1 0 1"), ("1 0", "x y")]) == [None, None]


def test_cumulative_parity(spark):
    # truth y z pairs: (1,1),(0,1): values 0, 0^1^1=0
    truth = "1 1 0 1"
    got = score(spark, sc.score_cumulative_parity, [
        ("1 1 0 1", truth),       # exact
        ("0 0 0 1", truth),       # first pair flipped together: pair0 same, z0 change disturbs pair1
        ("0 0 1 1", truth),       # the pair-1 error cancels the carried z0 error
    ])
    assert got == [1.0, 0.1, 1.0]


def test_tensor_table(spark):
    got = score(spark, sc.score_tensor, [
        ("#### 3", "3 and 4"), ("#### 3 #### 4 #### 5", "3 and 4"), ("#### 3 #### 5", "3 and 4"),
        ("#### 3 #### 4", "3 and 4"), ("#### x", "-1234"), ("#### -3 #### 4", "3 and 4"),
        ("#### 1,234 #### 4", "1234 and 4"), (None, "3"), ("#### 3", "x")])
    assert got == [0.0, 0.1, 0.1, 1.0, 1.0, 0.1, 0.1, 0.0, 0.1]


def _py_parity(sol, truth, cumulative=False):
    """Independent sequential model of the parity rule."""
    t = truth.split()
    if sol is None:
        return 0.0
    s = sol.split()[:len(t)]
    bad = 0
    for i in range(0, len(t), 2):
        try:
            hy, hz = int(s[i]), int(s[i + 1])
        except (IndexError, ValueError):
            return 0.0
        y, z = int(t[i]), int(t[i + 1])
        if cumulative:
            zp, hzp = (0, 0) if i == 0 else (int(t[i - 1]), int(s[i - 1]))
            bad += (y ^ z ^ zp) != (hy ^ hz ^ hzp)
        else:
            bad += (y ^ z) != (hy ^ hz)
    return 0.1 * (len(t) == len(sol.split())) + 0.9 * (bad == 0)


@pytest.mark.parametrize("cumulative", [False, True])
def test_parity_vs_model_on_views(spark, cumulative):
    d = V.parity_roll(spark, SF_SMALL, cumulative)
    fn = sc.score_cumulative_parity if cumulative else sc.score_parity
    for r in d.select("solution", "answer", fn(F.col("solution"), F.col("answer")).alias("s")).collect():
        assert r.s == pytest.approx(_py_parity(r.solution, r.answer, cumulative))


def test_sparse_token_reward(spark):
    d = spark.createDataFrame([(0, 0.5, 0), (1, 0.5, 1), (2, 0.5, 4)], "i int, r double, n int")
    v = [r[0] for r in d.orderBy("i").select(sc.sparse_token_reward(F.col("r"), F.col("n"), 4)).collect()]
    assert v == [[0.0] * 4, [0.5, 0.0, 0.0, 0.0], [0.0, 0.0, 0.0, 0.5]]


def test_passk_values(spark):
    d = spark.createDataFrame([(5, 2), (5, 0), (5, 5), (1, 1), (256, 100)], "n long, c long")
    per = ev.passk_per_problem(d.withColumn("p", F.monotonically_increasing_id()), "p", 256).collect()
    for r in per:
        exp = 0.0 if r.c == 0 or r.n < r.k else 1.0 if r.c == r.n else \
            1 - math.comb(r.n - r.c, r.k) / math.comb(r.n, r.k)
        assert r.passk == pytest.approx(exp, abs=1e-12)
    five = sorted((r.k, round(r.passk, 9)) for r in per if (r.n, r.c) == (5, 2))
    assert five == [(1, 0.4), (2, 0.7), (3, 0.9), (4, 1.0), (5, 1.0)]


def test_passk_monotone_and_curve(spark):
    counts = ev.problem_counts(V.rollouts(spark, SF_SMALL), "problem_id")
    per = ev.passk_per_problem(counts, "problem_id", 20).collect()
    by = {}
    for r in per:
        by.setdefault(r.problem_id, []).append((r.k, r.passk))
    for vals in by.values():
        ps = [p for _, p in sorted(vals)]
        assert all(a <= b + 1e-12 for a, b in zip(ps, ps[1:]))
    curve = {r.k: r.passk for r in ev.passk_curve(counts, 20).collect()}
    for k, v in curve.items():
        direct = [p for vals in by.values() for kk, p in vals if kk == k]
        assert v == pytest.approx(sum(direct) / len(direct), abs=1e-12)


def test_trajectory_bands_vs_matrix(spark):
    att = V.attempts(spark, SF_SMALL)
    led = cur.attempt_ledger(att.filter("split = 'train'"))
    mat = ev.trajectory_matrix(led, att).collect()
    bands = {r.t: r for r in ev.trajectory_bands(led).collect()}
    cols = {}
    for r in mat:
        if r.portion is not None:
            cols.setdefault(r.t, []).append((r.portion, r.reward))
    for t, vals in cols.items():
        ps = [p for p, _ in vals]
        m = sum(ps) / len(ps)
        sd = math.sqrt(sum((p - m) ** 2 for p in ps) / len(ps))
        assert bands[t].n == len(ps)
        assert bands[t].portion_mean == pytest.approx(m, abs=1e-9)
        assert bands[t].portion_std == pytest.approx(sd, abs=1e-6)
        assert 0.0 <= bands[t].portion_lo <= bands[t].portion_hi <= 1.0


def test_token_loss(spark):
    d = spark.createDataFrame([(0, 1.0, True), (0, 3.0, False), (1, 2.0, True), (1, 4.0, True)],
                              "batch int, loss double, mask boolean")
    r = {x.batch: x for x in ev.token_loss_metrics(d).collect()}
    assert r[0].masked_mean == pytest.approx(1.0) and r[1].masked_mean == pytest.approx(3.0)
    assert r[0].val_mean == pytest.approx(2.0)


def test_register_pandas_udf_scorer(spark):
    """The scorer hook accepts a vectorised pandas UDF next to Column builders."""
    import pandas as pd

    @F.pandas_udf("double")
    def exact(sol: pd.Series, truth: pd.Series) -> pd.Series:
        return (sol.fillna("").str.strip() == truth).astype("float64")

    sc.register_scorer("exact_text", lambda s, t: exact(s, t))
    try:
        d = spark.createDataFrame([("exact_text", " 4 ", "4"), ("exact_text", "5", "4"), ("tensor", "#### 4", "4")],
                                  "ds string, s string, t string")
        got = [r[0] for r in d.select(sc.score_dispatch(F.col("ds"), F.col("s"), F.col("t"))).collect()]
        assert got == [1.0, 0.0, 1.0]
    finally:
        sc.SCORERS.pop("exact_text", None)
