"""Prefix scans, bindings, records, the state log."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from rungkit.functions import scoring as sc
from rungkit.operators import curriculum as cur
from rungkit.operators import evaluate as ev
from rungkit.operators import normalize as nz
from rungkit.operators import ordering as od
from rungkit.operators.resample import weighted_resample
from rungkit.operators.scan import prefix_sums
from rungkit.session import scratch_path
from rungkit.sources import io
from rungkit.sources import views as V
from rungkit.streaming.curriculum_stream import advance

ATT = "sample_id long, step int, pos long, portion double, reward double, split string"


def sequential(rows, cfg=cur.DEFAULT):
    """Run ledger, contributions and moving averages by one loop over attempts."""
    runs, contrib, cap = {}, {}, {}
    for s, t, pos, p, r, _ in sorted(rows, key=lambda x: (x[1], x[2])):
        mine = runs.setdefault(s, [])
        if not mine or mine[-1][0] != p:
            mine.append([p, 0, 0.0, t, t])
        mine[-1][1] += 1
        mine[-1][2] += r
        mine[-1][4] = t
        contrib[s, t] = (len(mine), p, mine[-1][2] / mine[-1][1], mine[-1][1])
    out = {}
    for (s, t), (run, p, mean, n) in sorted(contrib.items(), key=lambda x: x[0][1]):
        before = cap.get(s, cfg.max_ratio)
        ok = mean >= cfg.reward_threshold
        cap[s] = p if ok else before
        out[s, t] = (run, p, round(mean, 9), n, ok, before, p if ok else before, 0.0 if ok else p)
    return runs, out


def hot_attempts(seed, n=3000):
    rng = random.Random(seed)
    rows = []
    for i in range(n):       # a third of all attempts are one sample's, with alternating portions
        s = 0 if i % 3 == 0 else rng.randrange(1, 40)
        p = (0.5, 0.25)[i // 3 % 2] if s == 0 else rng.choice([0.5, 0.5, 0.5, 0.25])
        rows.append((s, i // 200, i, p, float(rng.random() < 0.5), "train"))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_ledger_and_contributions_equal_one_loop(spark, seed):
    rows = hot_attempts(seed)
    att = spark.createDataFrame(rows, ATT).repartition(5)
    runs, contrib = sequential(rows)
    got = {}
    for r in cur.attempt_ledger(att).collect():
        got.setdefault(r.sample_id, {})[r.run_id] = [r.portion, r.n_rewards, r.reward_sum, r.first_step, r.last_step]
    assert got == {s: {i + 1: x for i, x in enumerate(mine)} for s, mine in runs.items()}
    c = {(r.sample_id, r.step): (r.run_id, r.portion, round(r.run_mean_reward, 9), r.run_n, r.success, r.max_ratio_before,
                                 r.upper_term, r.lower_term) for r in cur.step_contribution(att).collect()}
    assert c == contrib


def test_ledger_scan_sees_one_row_per_step(spark):
    rows = hot_attempts(3, 9000)
    seg = cur._local_runs(spark.createDataFrame(rows, ATT), "sample_id").groupBy("sample_id", "step", "local_run").agg(
        F.first("portion").alias("portion"), F.count("*").alias("n"), F.sum("reward").alias("reward_sum"))
    s = cur._step_summaries(seg, "sample_id")
    steps = len({r[1] for r in rows})
    # the hot sample has 3,000 runs; what its scan takes in one task is a row a step, and no task of runs has more than a sample-step's
    assert s.filter("sample_id = 0").count() == steps == 45
    assert seg.groupBy("sample_id", "step").count().agg(F.max("count")).first()[0] <= 200


def test_fold_with_prior_equals_one_pass(spark):
    rows = hot_attempts(4)
    att = spark.createDataFrame(rows, ATT)
    whole = {(r.sample_id, r.step): (r.run_n, r.run_sum, r.max_ratio_after) for r in cur.step_contribution(att).collect()}
    prior, got = None, {}
    for lo, hi in ((0, 4), (4, 5), (5, 11), (11, 99)):
        c = cur.step_contribution(att.filter((F.col("step") >= lo) & (F.col("step") < hi)), prior=prior)
        got |= {(r.sample_id, r.step): (r.run_n, r.run_sum, r.max_ratio_after) for r in c.collect()}
        new = cur.fold_state(c)
        prior = new if prior is None else prior.join(new.select("sample_id"), "sample_id", "left_anti").unionByName(new)
        prior = spark.createDataFrame(prior.collect(), new.schema)
    assert got == whole


@pytest.mark.parametrize("alpha,n", [(0.8, 1_000_000), (0.9999, 50_000), (0.01, 3_000), (0.0, 500), (1.0, 500), (1e-200, 300)])
def test_moving_average_equals_the_fold(spark, alpha, n):
    rng = np.random.default_rng(5)
    x = rng.random(n)
    steps = np.cumsum(rng.integers(1, 4, n))             # gaps between steps do not count
    import pandas as pd
    df = spark.createDataFrame(pd.DataFrame({"step": steps, "x": x}))
    got = cur.ema_scan(df, "step", alpha, {"m": ("x", 0.9)}).toPandas().sort_values("step")["m"].to_numpy()
    m, want = 0.9, np.empty(n)
    for i, v in enumerate(x.tolist()):
        m = alpha * m + (1 - alpha) * v
        want[i] = m
    assert np.abs(got - want).max() < 1e-12


def test_moving_average_has_no_list(spark):
    df = spark.range(5).select(F.col("id").alias("step"), F.lit(1.0).alias("x"))
    plan = cur.ema_scan(df, "step", 0.8, {"m": ("x", 0.0)})._jdf.queryExecution().toString()
    assert "collect_list" not in plan
    assert cur.ema_scan(df.limit(0), "step", 0.8, {"m": ("x", 0.0)}).count() == 0


def test_prefix_sums(spark):
    df = spark.range(100).select(F.col("id").alias("t"), F.when(F.col("id") % 3 > 0, F.col("id") * 0.5).alias("v"))
    got = {r.t: r.s for r in prefix_sums(df, "t", {"s": "v"}, block=7).collect()}
    at, want = 0.0, {}
    for t in range(100):
        at += t * 0.5 if t % 3 else 0
        want[t] = at
    assert got == want


@pytest.mark.parametrize("seed", [1, 2])
def test_bands_equal_the_matrix(spark, seed):
    rng = random.Random(seed)
    runs = [(s, i + 1, rng.choice([0.1, 0.3, 1 / 3]), rng.random()) for s in range(30) for i in range(rng.randint(1, 12))]
    ledger = spark.createDataFrame(runs, "sample_id long, run_id long, portion double, mean_reward double")
    top = max(r[1] for r in runs)
    by = {}
    for s, i, p, m in runs:
        by.setdefault(s, []).append((p, m))
    got = {r.t: r for r in ev.trajectory_bands(ledger).collect()}
    assert sorted(got) == list(range(top))
    for t, r in got.items():
        v = np.array([x[min(t, len(x) - 1)] for x in by.values()])
        assert r.n == len(by)
        assert np.allclose([r.portion_mean, r.reward_mean], v.mean(axis=0), atol=1e-13)
        assert np.allclose([r.portion_std, r.reward_std], v.std(axis=0), atol=1e-13)


def test_equal_values_have_no_spread(spark):
    runs = [(s, i + 1, 0.1, 0.7) for s in range(1000) for i in range(s % 5 + 1)]
    ledger = spark.createDataFrame(runs, "sample_id long, run_id long, portion double, mean_reward double")
    for r in ev.trajectory_bands(ledger).collect():
        assert r.portion_std < 1e-13 and r.reward_std < 1e-13        # E[x^2] - mean^2 leaves 1e-8


def test_index_of_keys_with_an_outlier(spark):
    df = spark.range(100_000).select(F.when(F.col("id") == 0, F.lit(10 ** 17)).otherwise(F.col("id")).alias("k"), F.lit("text").alias("t"))
    got = od.assign_index(df, "k").agg(F.min("index"), F.max("index"), F.countDistinct("index"),
                                       F.max(F.when(F.col("k") == 10 ** 17, F.col("index")))).first()
    assert tuple(got) == (0, 99_999, 100_000, 99_999)
    counts = df.groupBy(F.col("k").alias("_key")).agg(F.count("*").alias("_n"))
    sizes = [r["count"] for r in counts.repartitionByRange(8, "_key").groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) < 2 * 100_000 / 8


def test_index_with_repeated_and_null_keys(spark):
    rows = [("a", 5), ("a", 5), ("a", None), ("a", -3), (None, 1), (None, None), ("b", 7)]
    df = spark.createDataFrame(rows, "g string, k long")
    got = sorted((str(r.g), r["index"], r.k) for r in od.assign_index(df, "k", "g").collect())
    assert got == [("None", 0, None), ("None", 1, 1), ("a", 0, None), ("a", 1, -3), ("a", 2, 5), ("a", 3, 5), ("b", 0, 7)]


def test_small_weights_can_be_drawn(spark):
    df = spark.range(3000).select("id", F.when(F.col("id") < 2999, F.lit(1e-9)).otherwise(F.lit(0.0)).alias("w"))
    got = {r.id for r in weighted_resample(df, "id", "w").collect()}
    assert 2999 not in got and len(got) > 1500


# ------------------------------------------------------------------ scoring

def test_bindings_and_status(spark):
    rows = [("xor/sequence_8_bitwidth_1", "1 0", "1 0"), ("xor/r3_sequence_16_bitwidth_1", "1 0 1 1", "1 0 1 1"),
            ("xor/sequence", "1 x", "1 0"), ("xor/sequence", "1 0", "1 z"), ("xor/sequencer", "#### 4", "4"),
            ("tensor", "#### 3 #### 4", "3 and 4"), ("tensor", "3", "3 and 4"), ("openai/gsm8k", "no number", "4"),
            ("openai/gsm8k", "\\boxed{4}", "4"), (None, "#### 4", "4"), ("openai/gsm8k", "#### 4", None), ("tensor", None, "1")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, data_source string, solution string, ground_truth string")
    got = {r.i: (r.scorer, r.score, r.status) for r in sc.score_bound(sc.bound(df, sc.bindings_table(spark))).collect()}
    assert got == {
        0: ("parity", 1.0, "ok"), 1: ("cumulative_parity", 1.0, "ok"), 2: ("parity", 0.0, "unparsable"),
        3: ("parity", None, "malformed"), 4: ("exact", 1.0, "ok"), 5: ("tensor", 1.0, "ok"), 6: ("tensor", 0.0, "unparsable"),
        7: ("exact", 0.0, "unparsable"), 8: ("exact", 1.0, "ok"), 9: ("exact", 1.0, "ok"), 10: ("exact", None, "malformed"),
        11: ("tensor", 0.0, "unparsable")}
    one = [r[0] for r in df.orderBy("i").select(sc.score_dispatch(F.col("data_source"), F.col("solution"), F.col("ground_truth"))).collect()]
    assert one == [got[i][1] for i in range(len(rows))]


def test_map_valued_scores_flatten(spark):
    df = spark.createDataFrame([(1, "tensor", "#### 3", "3 and 4"), (2, "openai/gsm8k", "#### 3", "3")],
                               "i int, data_source string, solution string, ground_truth string")
    long = sc.metrics_flatten(sc.score_bound(sc.bound(df, sc.bindings_table(spark))), "i")
    assert sorted(map(tuple, long.collect())) == [(1, "n_pieces", 1.0), (1, "n_truths", 2.0), (1, "score", 0.0), (2, "score", 1.0)]


def test_own_binding_table(spark):
    df = spark.createDataFrame([(1, "mine_2", "1 0", "1 0"), (2, "mine", "#### 1", "1")], "i int, data_source string, solution string, ground_truth string")
    table = sc.bindings_table(spark, {"mine_2": "parity", "mine": "exact"})
    assert sorted((r.i, r.scorer, r.score) for r in sc.score_bound(sc.bound(df, table)).collect()) == [(1, "parity", 1.0), (2, "exact", 1.0)]
    with pytest.raises(Exception, match="no scorer named nobody"):
        sc.score_bound(sc.bound(df, sc.bindings_table(spark, {"mine": "nobody"}))).collect()


def test_binding_leaves_rows_where_they_are(spark):
    """However few data sources the rows share, they are not gathered by them."""
    source = F.concat(F.lit("xor/sequence_16_bitwidth_"), F.col("id") % 2)
    df = spark.range(800).repartition(8).select("id", source.alias("data_source"))
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        got = sc.bound(df, sc.bindings_table(spark)).groupBy(F.spark_partition_id().alias("p"), "scorer").count().collect()
    finally:
        spark.conf.set(key, before)
    assert len(got) == 8 and {r.scorer for r in got} == {"parity"} and sum(r["count"] for r in got) == 800
    plan = sc.bound(df, sc.bindings_table(spark))._jdf.queryExecution().analyzed().toString()
    assert plan.count("Range") == 1                      # the rows are made once


def test_binding_tables_of_odd_rows(spark):
    df = spark.createDataFrame([(1, "a_b_c"), (2, "a_b"), (3, "a"), (4, "ab_c"), (5, None), (6, ""), (7, "_a"), (8, "a_n_x")], "i int, data_source string")
    table = spark.createDataFrame([("a", "one"), ("a_b", "two"), (None, "three"), ("a_n", None), ("a_b", "two")], "source string, scorer string")
    want = {1: "two", 2: "two", 3: "one", 4: "exact", 5: "exact", 6: "exact", 7: "exact", 8: "exact"}
    assert {r.i: r.scorer for r in sc.bound(df, table).collect()} == want
    got = sc.bound(df, table.limit(0))
    assert got.columns == ["i", "data_source", "scorer"] and {r.scorer for r in got.collect()} == {"exact"}


# ------------------------------------------------------------------ records and grid

def test_eval_records(spark):
    problems = spark.createDataFrame([(1, "openai/gsm8k", [("user", "q1")], "4"), (2, "openai/gsm8k", [("user", "q2")], "5"), (3, "openai/gsm8k", None, "6")],
                                     "id long, data_source string, prompt array<struct<role:string,content:string>>, ground_truth string")
    rows = [(1, 1, "#### 5"), (1, 0, "#### 4"), (1, 2, None), (2, 0, "#### 4")]
    done = spark.createDataFrame(rows, "id long, sample_no long, completion string")
    score = lambda d: sc.score_bound(sc.bound(d, sc.bindings_table(spark)))
    records = io.eval_records(problems, done, "id", 2, score)
    path = scratch_path(spark, "test_records")
    io.write_eval_records(records, path)
    back = {r.id: r for r in io.read_eval_jsonl(spark, path).collect()}
    assert back[1].completions == ["#### 4", "#### 5", None] and back[1].rewards == [1.0, 0.0, 0.0]
    assert back[1]["pass@k"] == {"1": pytest.approx(1 / 3), "2": pytest.approx(2 / 3)} and back[1].prompt[0].content == "q1"
    assert back[2]["pass@k"] == {"1": 0.0} and back[2].successes == [False]
    assert back[3].completions == [] and back[3]["pass@k"] == {} and back[3].ground_truth == "6"
    with pytest.raises(ValueError, match="ground_truth"):
        io.eval_records(problems.drop("ground_truth"), done, "id", 2, score)
    with pytest.raises(ValueError, match="rewards should be"):
        io.write_eval_records(records.withColumn("rewards", F.lit("x")), path)


def test_ratio_grid(spark):
    problems = spark.createDataFrame([(1, "one two  three four", "four"), (2, "", "x")], "id long, answer string, ground_truth string")
    done = spark.createDataFrame([(1, 0, "a b c d"), (1, 1, "a"), (1, 2, None), (2, 0, "x")], "id long, sample_no long, completion string")
    seen = {"same": lambda s, t: (s == "one two  c d").cast("double"), "length": lambda s, t: F.length(s).cast("double")}
    got = {(r.id, r.ratio): (r.same, r.length) for r in ev.ratio_grid(problems, done, "id", [0.1, 0.5, 1.0], seen).collect()}
    assert got[1, 0.5] == ([1.0, 0.0, None], [float(len("one two  c d")), float(len("one two  ")), None])
    assert got[1, 0.1][1] == [7.0, 1.0, None] and got[1, 1.0][1] == [19.0, 19.0, None] and got[2, 0.5][1] == [1.0]


# ------------------------------------------------------------------ state log

def test_state_log_resumes_and_compacts(spark):
    att = V.attempts(spark, SF_SMALL)
    root, kinds = scratch_path(spark, "test_log"), []
    edges = [3, 6, 9, 14, 20, 40]
    for lo, hi in zip([-1, *edges], edges):
        step = advance(att.filter((F.col("step") > lo) & (F.col("step") <= hi)), root, compact_every=3)
        base, deltas = io.state_base(spark, root, step)
        kinds.append((base == step, len(deltas)))
        upto = att.filter(F.col("step") <= hi)
        want = {r.sample_id: (r.last_portion, r.run_n, r.run_sum, r.max_per_sample_ratio, r.last_step)
                for r in cur.fold_state(cur.step_contribution(upto.filter("split = 'train'"))).collect()}
        per, glob, _ = io.state_restore(spark, root)
        assert {r.sample_id: (r.last_portion, r.run_n, r.run_sum, r.max_per_sample_ratio, r.last_step) for r in per.collect()} == want
        whole = cur.final_bounds(cur.ema_bounds(cur.step_contribution(upto.filter("split = 'train'")))).first()
        assert math.isclose(glob.first().mean_max_ratio, whole.mean_max_ratio, rel_tol=1e-12)
    assert kinds == [(True, 0), (False, 1), (False, 2), (True, 0), (False, 1), (False, 2)]
    assert advance(att.limit(0), root) == step


def test_deltas_hold_touched_samples_only(spark):
    rows = [(s, 0, s, 0.5, 1.0, "train") for s in range(500)] + [(7, 1, 1000, 0.25, 0.0, "train")]
    att, root = spark.createDataFrame(rows, ATT), scratch_path(spark, "test_delta")
    advance(att.filter("step = 0"), root)
    advance(att.filter("step = 1"), root)
    assert spark.read.parquet(f"{root}/step=1/samples").count() == 1
    per, _, _ = io.state_restore(spark, root)
    assert per.count() == 500 and per.filter("sample_id = 7").first().last_portion == 0.25


def test_unfinished_version_does_not_count(spark):
    df = spark.createDataFrame([(1, 0.5)], "sample_id long, last_portion double")
    root = scratch_path(spark, "test_unfinished")
    io.state_snapshot(df, df, root, 1)
    df.write.parquet(f"{root}/step=2/samples")
    df.write.parquet(f"{root}/step=2/global")
    assert io.complete_steps(spark, root) == [1] and io.latest_step(spark, root) == 1


def test_normalised_rows_score_one(spark):
    qa = nz.norm_hash(V.qa_hash(spark, SF_SMALL))[0]
    d = qa.select("data_source", F.col("answer").alias("solution"), F.col("reward_model.ground_truth").alias("ground_truth"))
    assert sc.score_bound(sc.bound(d, sc.bindings_table(spark))).filter("score <> 1").count() == 0


# ------------------------------------------------------------------ token dictionaries

def test_chunk_dictionaries_encode_every_position(spark, monkeypatch):
    from rungkit.operators import sequences as sq
    monkeypatch.setattr(sq, "CHUNK_ROWS", 4)
    rng = random.Random(8)
    rows = [(i if i % 9 else None, " ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(rng.randint(0, 30))),
             None if i % 7 == 0 else "x a") for i in range(60)]
    df = spark.createDataFrame(rows, "id long, t string, u string").repartition(3)
    vocab = sq.vocab_build(df, ["t", "u"])
    ids = {r.token: r.id for r in vocab.collect()}
    out = sq.encode_many(df, "id", {"a": F.col("t"), "b": F.col("u")}, vocab)
    got = sorted((str(r.id), r.t, r.a, r.b) for r in out.collect())
    assert got == sorted((str(i), t, [ids[w] for w in t.split()], [ids[w] for w in (u or "").split()]) for i, t, u in rows)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "posexplode" not in plan
    few = vocab.filter("token <> 'a'")
    some = sq.encode(df, "id", F.col("u"), few, "b", unknown_id=99)
    assert {tuple(r.b) for r in some.collect()} == {(), (ids["x"], 99)}
    with pytest.raises(Exception, match="outside the vocabulary"):
        sq.encode(df, "id", F.col("u"), few, "b").collect()
    assert sq.encode(df.limit(0), "id", F.col("u"), vocab, "b").count() == 0


def test_padding_report(spark):
    from rungkit.operators import sequences as sq
    df = spark.createDataFrame([(0, 3), (0, 12), (1, 4), (1, 4)], "b int, n int")
    got = {r.b: r for r in sq.padding_report(df, "b", F.col("n"), 10).collect()}
    assert (got[0].n_truncated, got[0].tokens, got[0].tokens_lost, got[0].longest) == (1, 13, 2, 10)
    assert got[0].waste_fixed == pytest.approx(0.35) and got[1].waste_fixed == pytest.approx(0.6) and got[1].waste_dynamic == 0
