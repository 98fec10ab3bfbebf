"""Hand golden tables for the text rules (FIXTURES part C)."""

import pytest
from pyspark.sql import functions as F

from rungkit.functions import text as tx
from rungkit.operators import normalize as nz
from rungkit.operators.dedup import dedup_first, dedup_report


def one(spark, col_fn, values, dtype="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {dtype}")
    return [r[0] for r in df.orderBy("i").select(col_fn(F.col("v"))).collect()]


def test_extract_hash_answer(spark):
    got = one(spark, tx.extract_hash_answer,
              ["x\n#### 72", "#### -1,234", "#### 72.", "####72", "#### 1 then #### 2", "", None])
    assert got == ["72", "-1234", "72.", None, "1", None, None]


def test_canonical_int(spark):
    assert one(spark, tx.canonical_int, ["007", "-0", "72.", "12"]) == ["7", "0", "72.", "12"]


def test_last_boxed(spark):
    got = one(spark, tx.last_boxed, [
        "a \\boxed{1} b \\boxed{2}", "\\boxed{\\frac{1}{2}}", "\\boxed{a{b{c{d}}}}", "\\boxed{open", "none", None])
    assert got == ["2", "\\frac{1}{2}", "a{b{c{d}}}", None, None, None]


def test_base7_rewrite(spark):
    got = one(spark, tx.base7_rewrite, ["7", "0", "000", "1,000", "1234567", "x9", "3.5", "49-7", "é12 a", None])
    # "x9": no word boundary before the digit; "3.5" -> 3 and 5 are tokens (both < 7)
    assert got == ["10", "0", "0", "1,0", "1234567", "x9", "3.5", "100-10", "é12 a", None]


def test_mod7_rewrite(spark):
    assert one(spark, tx.mod7_rewrite, ["8 and 14", "1234567"]) == ["1 and 0", "1234567"]


def test_base7_final_answer(spark):
    got = one(spark, tx.base7_final_answer, ["so #### 49", "#### -8 more", "#### 1,000", "no marker"])
    assert got == ["so #### 100", "#### -11 more", "#### 2626", "no marker"]


def test_is_int_and_words(spark):
    assert one(spark, tx.is_int_text, [" 7 ", "7.0", "", None, "-3", "+4", "1_0"]) == \
        [True, False, False, False, True, True, False]
    assert one(spark, tx.word_count, ["a  b\tc\n", "", "   "]) == [3, 0, 0]


def test_pick_solution(spark):
    df = spark.createDataFrame([
        (0, "  ", ["", "  g1 ", "g2"], [False, True, True]),      # flagged blank skipped -> g1
        (1, None, ["a", "b"], [False, True]),                     # second flagged
        (2, "", ["", "c"], [True]),                               # shorter flags -> first non-blank
        (3, "", ["  ", ""], [True, True]),                        # all blank -> ''
        (4, None, None, None),
        (5, " sol ", ["x"], [True]),
    ], "i int, s string, g array<string>, f array<boolean>")
    got = [r[0] for r in df.orderBy("i").select(tx.pick_solution("s", "g", "f")).collect()]
    assert got == ["g1", "b", "c", "", "", "sol"]


def test_filter_int_answer_words(spark):
    words = lambda n: " ".join(["w"] * n)
    df = spark.createDataFrame([
        (0, " 7 ", words(100)), (1, "7.0", words(100)), (2, "", words(100)), (3, None, words(100)),
        (4, "-3", words(1000)), (5, "5", words(99)), (6, "5", words(1001)),
    ], "i int, answer string, picked string")
    kept = sorted(r.i for r in nz.filter_int_answer_words(df).collect())
    assert kept == [0, 4]


def test_dedup_first_prompt(spark):
    p = lambda *c: [{"role": "user", "content": x} for x in c]
    df = spark.createDataFrame([
        (3, p("a", "x")), (1, p("a", "y")), (2, p("b")), (4, None), (5, []), (6, [])],
        "i int, prompt array<struct<role:string,content:string>>")
    kept = sorted(r.i for r in dedup_first(df, "i").collect())
    assert kept == [1, 2, 4, 5]
    again = sorted(r.i for r in dedup_first(dedup_first(df, "i"), "i").collect())
    assert again == kept
    rep = dedup_report(df, dedup_first(df, "i")).first()
    assert (rep.original, rep.kept, rep.removed, rep.reduction_pct) == (6, 4, 2, 33.33)


def test_dedup_report_empty(spark):
    df = spark.createDataFrame([], "i int, prompt string")
    rep = dedup_report(df, df).first()
    assert rep.original == 0 and rep.reduction_pct is None


def test_norm_hash_quarantine_and_raise(spark):
    df = spark.createDataFrame([(1, "q", "r\n#### 5", "train"), (2, "q", "no marker", "train")],
                               "id long, question string, answer string, split string")
    good, bad = nz.norm_hash(df)
    assert [r.id for r in good.collect()] == [1] and [r.id for r in bad.collect()] == [2]
    row = good.first()
    assert row.prompt[0].content == "q " + nz.INSTR_HASH and row.reward_model.ground_truth == "5"
    assert row.extra_info["index"] is None and row.extra_info.partial_answer is None
    strict, _ = nz.norm_hash(df, on_bad="raise")
    with pytest.raises(Exception):
        strict.collect()
