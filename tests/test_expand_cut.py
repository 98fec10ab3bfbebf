"""Expansion and portion-cut rules, with the reconstruction properties."""

from pyspark.sql import functions as F

from rungkit.operators.expand import expand_steps, expand_words_k, reindex_expanded
from rungkit.operators.portion import apply_curriculum, cut_by_portion


def _df(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, answer string")


def test_expand_steps_from0(spark):
    ex = expand_steps(_df(spark, ["a", "a\nb\n", ""]), "answer", first_step=0)
    got = [(r.id, r.pos, r.j, r.partial_answer, r.completion, r.portion) for r in ex.orderBy("id", "pos").collect()]
    assert got == [
        (0, 0, None, None, None, None), (0, 1, 0, "", "a", 0.0),
        (1, 0, None, None, None, None), (1, 1, 0, "", "a\nb\n", 0.0), (1, 2, 1, "a", "b\n", 1 / 3),
        (1, 3, 2, "a\nb", "", 2 / 3),
        (2, 0, None, None, None, None), (2, 1, 0, "", "", 0.0)]


def test_expand_steps_from1(spark):
    ex = expand_steps(_df(spark, ["a\nb"]), "answer", first_step=1)
    got = [(r.pos, r.partial_answer, r.completion, r.portion) for r in ex.orderBy("pos").collect()]
    assert got == [(0, None, None, None), (1, "a", "b", 0.5), (2, "a\nb", "", 1.0)]


def test_expand_words_k(spark):
    ex = expand_words_k(_df(spark, ["x  y", "", "a b c d e"]), "answer", k=4)
    got = {}
    for r in ex.collect():
        got.setdefault(r.id, []).append((r.pos, r.cutoff, r.partial_answer))
    assert sorted(got[0]) == [(0, None, None), (1, 1, "x"), (2, 1, "x"), (3, 2, "x y"), (4, 2, "x y")]
    assert sorted(got[1]) == [(0, None, None)]
    assert [c for _, c, _ in sorted(got[2])][1:] == [2, 3, 4, 5]


def test_reindex_contiguous(spark):
    d = _df(spark, ["a\nb", "c", "d\ne\nf"])
    ex = reindex_expanded(expand_steps(d, "answer", 0), "id", F.col("n_steps") + 1)
    idx = sorted(r["index"] for r in ex.collect())
    assert idx == list(range(ex.count())) == list(range(3 + 2 + 4))


def test_cut_modes(spark):
    d = spark.createDataFrame([(0, "  ab  cd ef", 0.5), (1, "éàü", 0.67), (2, "a\nb\nc", 0.98), (3, "abc", 0.0),
                               (4, "one", 0.4)], "id long, answer string, p double")
    chunk = {r.id: (r.partial_answer, r.completion) for r in cut_by_portion(d, "answer", F.col("p"), None).collect()}
    assert chunk[0] == ("ab  ", "cd ef")            # leading spaces dropped, spacing kept
    assert chunk[3] == (None, None) and chunk[4] == (None, None)   # portion 0 / empty cut -> unset
    char = {r.id: (r.partial_answer, r.completion) for r in cut_by_portion(d, "answer", F.col("p"), "char").collect()}
    assert char[1] == ("éà", "ü")          # int(3 * 0.67) = 2 characters
    sep = {r.id: (r.partial_answer, r.completion) for r in cut_by_portion(d, "answer", F.col("p"), "\n").collect()}
    assert sep[2] == ("a\nb", "c")


def test_cut_reconstructs(spark):
    texts = ["w1 w2\nw3  w4\n\nw5", "x", "a\tb c"]
    d = spark.createDataFrame([(i, t, p) for i, t in enumerate(texts) for p in (0.1, 0.5, 0.9)],
                              "id long, answer string, p double")
    for mode, sep in (("char", ""), ("\n", "\n")):
        for r in cut_by_portion(d, "answer", F.col("p"), mode).collect():
            if r.partial_answer is not None:
                assert r.partial_answer + sep + r.completion == r.answer if mode != "char" else \
                    r.partial_answer + r.completion == r.answer


def test_history_bypass(spark):
    d = spark.createDataFrame([(0, "a b c d", None, None, None), (1, "a b", "", "a b", 0.0)],
                              "id long, answer string, partial_answer string, completion string, portion double")
    out = {r.id: r for r in apply_curriculum(d, "answer", F.lit(0.5), None).collect()}
    assert out[0].bypass is False and out[0].partial_answer == "a b " and out[0].portion == 0.5
    assert out[1].bypass is True and out[1].partial_answer == "" and out[1].portion == 0.0
