"""Cases in which earlier versions lost, doubled or mis-scored rows."""

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from rungkit.functions import scoring as sc
from rungkit.functions import text as tx
from rungkit.operators import dedup, ordering, sequences
from rungkit.operators.project import nested_project
from rungkit.operators.resample import weighted_resample
from rungkit.sources import views as V
from rungkit.streaming import curriculum_stream as cs


def test_resample_reaches_all_rows_at_large_totals(spark):
    st = spark.range(2000).select(F.col("id").alias("k"), F.lit(5e9).alias("w"))      # total 1e19 before, 1e16 x 1e3 scaled
    st = st.withColumn("w", F.col("w") / 1000)                                           # scaled total 1e16
    got = [r.k for r in weighted_resample(st, "k", "w", seed=1).collect()]
    assert len(got) == 2000 and max(got) > 1900 and min(got) < 100 and 1150 < len(set(got)) < 1400


def test_resample_keeps_the_number_of_draws(spark):
    st = spark.createDataFrame([(1, 1e-7), (2, 1.0), (3, 0.0)], "k long, w double")
    got = weighted_resample(st, "k", "w").collect()
    assert sorted(r.draw_id for r in got) == [0, 1, 2] and {r.k for r in got} == {2}


@pytest.mark.parametrize("w", [None, -1.0])
def test_resample_rejects_bad_weights(spark, w):
    st = spark.createDataFrame([(1, w), (2, 1.0)], "k long, w double")
    with pytest.raises(Exception, match="at least 0"):
        weighted_resample(st, "k", "w").collect()


def test_index_keeps_null_groups_and_keys(spark):
    rows = [("a", 3), ("a", None), (None, 5), (None, 1), ("b", 7)]
    df = spark.createDataFrame(rows, "g string, k long")
    got = {(r.g, r.k): r["index"] for r in ordering.assign_index(df, "k", "g").collect()}
    assert got == {("a", None): 0, ("a", 3): 1, (None, 1): 0, (None, 5): 1, ("b", 7): 0}
    plain = {r.k: r["index"] for r in ordering.assign_index(df.select("k"), "k").collect()}
    assert plain == {None: 0, 1: 1, 3: 2, 5: 3, 7: 4}


def test_take_first_n_fails_when_short(spark):
    assert ordering.take_first_n(spark.range(5), "id", 3).count() == 3
    assert ordering.take_first_n(spark.range(3), "id", 10, strict=False).count() == 3
    with pytest.raises(Exception, match="asked for 10 rows, found 3"):
        ordering.take_first_n(spark.range(3), "id", 10).collect()


def test_tensor_score_of_missing_truth_is_null(spark):
    df = spark.createDataFrame([("#### 1 #### 2", "1 and 2"), ("#### 1", None), (None, "1"), ("#### 1 #### 3", "1 and 2")],
                               "s string, t string")
    assert [r.v for r in df.select(sc.score_tensor(F.col("s"), F.col("t")).alias("v")).collect()] == [1.0, None, 0.0, 0.1]


def test_dispatch_scores_what_normalisers_label(spark):
    rows = [("xor/sequence_16_bitwidth_1", "1 0 1 1", "0 1 1 1"), ("xor/cumulative_sequence_16_bitwidth_1", "1 0", "1 0"),
            ("xor/sequence", "1 0 1 1", "0 1 1 1"), ("boxed", r"so \boxed{7}", "7"), ("gsm8k", "#### 7", "7"),
            ("boxed", r"\boxed{8}", "7"), ("gsm8k", "none", "7"), ("gsm8k", "#### 7", None)]
    df = spark.createDataFrame(rows, "d string, s string, t string")
    got = [r.v for r in df.select(sc.score_dispatch(F.col("d"), F.col("s"), F.col("t")).alias("v")).collect()]
    assert got == [1.0, 1.0, 1.0, 1.0, 1.0, 0.0, 0.0, None]


def test_base7_answer_that_does_not_parse_stays(spark):
    df = spark.createDataFrame([("x #### 72.",), ("x #### 72",), (None,)], "a string")
    assert [r.v for r in df.select(tx.base7_final_answer("a").alias("v")).collect()] == ["x #### 72.", "x #### 132", None]


def test_nested_project_rejects_longer_lists(spark):
    df = spark.createDataFrame([([("a",)],), ([("a",), ("b",)],)], "p array<struct<content:string>>")
    one = nested_project(df.where(F.size("p") == 1), {"c": ("p", ["content"])}).collect()
    assert one[0].c == "a"
    with pytest.raises(Exception, match="sequence of several"):
        nested_project(df, {"c": ("p", ["content"])}).collect()


def test_unseen_token_is_unknown_or_fails(spark):
    vocab = sequences.vocab_build(spark.createDataFrame([("a b",)], "t string"), "t")
    df = spark.createDataFrame([(1, "a z b")], "k long, t string")
    assert sequences.encode(df, "k", F.col("t"), vocab, "ids", unknown_id=9).first().ids == [2, 9, 3]
    with pytest.raises(Exception, match="outside the vocabulary: z"):
        sequences.encode(df, "k", F.col("t"), vocab, "ids").collect()


def test_dedup_sorts_no_text_and_keeps_a_null_prompt(spark):
    df = spark.createDataFrame([(3, "p"), (1, "p"), (2, "q"), (5, None), (4, None)], "o long, prompt string")
    out = dedup.dedup_first(df, "o")
    assert sorted(r.o for r in out.collect()) == [1, 2, 4]
    assert "SortAggregate" not in out._jdf.queryExecution().toString()


def test_interrupted_fold_counts_every_step_once(spark, tmp_path, monkeypatch):
    att = cs.as_stream_rows(V.attempts(spark, SF_SMALL)).cache()
    paths = cs.StreamPaths(*[str(tmp_path / x) for x in ("source", "closed", "ckpt")])
    state = str(tmp_path / "state")
    att.filter("step < 10").write.parquet(paths.source)
    cs.run_until_idle(spark, paths)
    with monkeypatch.context() as m:
        def broken(*a):
            raise OSError("lost")
        m.setattr(cs, "state_snapshot", broken)
        with pytest.raises(OSError):
            cs.incremental_update(spark, paths, state)
    att.filter("step >= 10 and step < 16").write.mode("append").parquet(paths.source)
    late = att.filter("step = 2").limit(3).withColumn("pos", F.col("pos") + 10 ** 9)
    cs.run_until_idle(spark, paths)
    late.write.mode("append").parquet(paths.source)
    assert cs.run_until_idle(spark, paths) == 3
    cs.incremental_update(spark, paths, state)
    steps = [r.step for r in cs.incremental_ema(spark, state).select("step").collect()]
    assert sorted(steps) == sorted(set(steps)) and {0, 1, 14} <= set(steps)
    assert cs.late_attempts(spark, paths).count() == 3
    att.unpersist()


def test_weight_and_dataset_hooks(spark):
    from rungkit.operators import curriculum as cur
    st = spark.createDataFrame([(1, 0.5, 0.2)], "sample_id long, last_mean_reward double, last_portion double")
    assert cur.sampling_weights(st, weight_fn=lambda d: d["last_portion"] * 10).first().weight == 2.0
    assert cur.dataset_portion(st, "base", 0.25).first().portion == 0.25
    assert cur.dataset_portion(st, "adaptive", adaptive=lambda d: d.withColumn("portion", F.lit(0.5))).first().portion == 0.5
    with pytest.raises(ValueError, match="dataset type"):
        cur.dataset_portion(st, "other")


def test_position_ids_with_and_without_gaps(spark):
    masks = [[0, 0, 1, 1, 1], [1, 1, 0, 0], [1, 0, 1, 1, 0], [0, 0], [], [1], None]
    df = spark.createDataFrame([(m,) for m in masks], "m array<int>")
    got = [r.p for r in df.select(sequences.position_ids(F.col("m")).alias("p")).collect()]
    want = []
    for m in masks:
        s, out = 0, []
        for x in m or []:
            s += x
            out.append(max(s - 1, 0))
        want.append(None if m is None else out)
    assert got == want
