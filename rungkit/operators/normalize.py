"""Normalisation of raw QA tables into the canonical nested ``rl_row``.

Each normaliser is one projection (plus a filter for quarantined rows);
``on_bad='raise'`` turns a missing answer into a job failure instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rungkit.functions import text as tx

# ---- fixed values: data sources and instruction suffixes of the source rules
DS_GSM8K = "openai/gsm8k"
DS_MATH = "DigitalLearningGmbH/MATH-lighteval"
DS_DEEPSCALER = "agentica-org/DeepScaleR-Preview-Dataset"
DS_OPENMATH_FORCED = "lighteval/MATH"
INSTR_HASH = "Let's think step by step and output the final answer after \"####\"."
INSTR_BOXED = "Let's think step by step and output the final answer within \\boxed{}."
INSTR_OPENR1 = "Please reason step by step, and put your final answer within \\boxed{}."
INSTR_BASE7 = "Let's think step by step and output the final answer after \"####\" "
INSTR_PARITY = ""

EXTRA_INFO = T.StructType([
    T.StructField("split", T.StringType()),
    T.StructField("index", T.LongType()),
    T.StructField("orig_index", T.LongType()),
    T.StructField("question", T.StringType()),
    T.StructField("problem", T.StringType()),
    T.StructField("problem_type", T.StringType()),
    T.StructField("question_type", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("partial_answer", T.StringType()),
    T.StructField("completion", T.StringType()),
    T.StructField("portion", T.DoubleType()),
])
RL_ROW = T.StructType([
    T.StructField("data_source", T.StringType()),
    T.StructField("prompt", T.ArrayType(T.StructType([T.StructField("role", T.StringType()),
                                                      T.StructField("content", T.StringType())]))),
    T.StructField("answer", T.StringType()),
    T.StructField("ability", T.StringType()),
    T.StructField("reward_model", T.StructType([T.StructField("style", T.StringType()),
                                                T.StructField("ground_truth", T.StringType())])),
    T.StructField("extra_info", EXTRA_INFO),
])


class MissingAnswer(ValueError):
    pass


def extra_info(**fields) -> Column:
    """Full-union extra_info struct; absent fields are typed NULLs."""
    out = []
    for f in EXTRA_INFO.fields:
        v = fields.get(f.name)
        v = F.lit(None) if v is None else (v if isinstance(v, Column) else F.lit(v))
        out.append(v.cast(f.dataType).alias(f.name))
    return F.struct(*out)


def rl_row(data_source, content: Column, answer: Column, truth: Column, extra: Column,
           keep=()) -> list[Column]:
    ds = data_source if isinstance(data_source, Column) else F.lit(data_source)
    return [*[F.col(k) for k in keep],
            ds.alias("data_source"),
            F.array(F.struct(F.lit("user").alias("role"), content.alias("content"))).alias("prompt"),
            answer.alias("answer"),
            F.lit("math").alias("ability"),
            F.struct(F.lit("rule").alias("style"), truth.alias("ground_truth")).alias("reward_model"),
            extra.alias("extra_info")]


def with_question(q: Column, instr: str, sep: str = " ") -> Column:
    """question + sep + instruction (the separator is kept even for an empty instruction)."""
    return F.concat(q, F.lit(sep + instr))


def quarantine_split(df: DataFrame, ok: Column, on_bad: str = "quarantine"):
    """Return (good, bad). ``on_bad='raise'`` fails the job on any bad row."""
    flagged = df.withColumn("_ok", F.coalesce(ok, F.lit(False)))
    if on_bad == "raise":
        # a filter predicate is never pruned, so every row is checked
        good = flagged.filter(F.when(F.col("_ok"), F.lit(True))
                              .otherwise(F.raise_error(F.lit("row without a valid answer")).cast("boolean")))
        return good.drop("_ok"), flagged.filter("false").drop("_ok")
    if on_bad != "quarantine":
        raise ValueError(on_bad)
    return flagged.filter("_ok").drop("_ok"), flagged.filter(~F.col("_ok")).drop("_ok")


def norm_hash(df: DataFrame, key="id", on_bad="quarantine", instr=INSTR_HASH, ds=DS_GSM8K,
              index: str | None = None):
    """GSM8K-type: question + ' ' + instr; truth after ``####``; extra = split, question."""
    d = df.withColumn("_gt", tx.extract_hash_answer("answer"))
    good, bad = quarantine_split(d, F.col("_gt").isNotNull(), on_bad)
    ex = extra_info(split=F.col("split"), question=F.col("question"),
                    index=F.col(index) if index else None)
    out = good.select(*rl_row(ds, with_question(F.col("question"), instr), F.col("answer"), F.col("_gt"), ex,
                              keep=[key]))
    return out, bad.drop("_gt")


def norm_base7(df: DataFrame, key="id", on_bad="quarantine"):
    """Integer-only rows, numbers rewritten to base 7, truth taken after the rewrite."""
    d = df.filter(~(tx.has_decimal("question") | tx.has_decimal("answer")))
    d = d.withColumn("q7", tx.base7_rewrite("question")).withColumn("a7", tx.base7_rewrite("answer"))
    d = d.withColumn("_gt", tx.canonical_int(tx.extract_hash_answer("a7")))
    good, bad = quarantine_split(d, F.col("_gt").isNotNull(), on_bad)
    ex = extra_info(split=F.col("split"), question=F.col("q7"))
    out = good.select(*rl_row(DS_GSM8K, with_question(F.col("q7"), INSTR_BASE7), F.col("a7"), F.col("_gt"), ex,
                              keep=[key]))
    return out, bad.drop("_gt")


def norm_boxed(df: DataFrame, key="id", on_bad="quarantine", index="index"):
    """MATH-type: problem + ' ' + instr; truth = last boxed of the solution."""
    d = df.withColumn("_gt", tx.last_boxed("solution"))
    good, bad = quarantine_split(d, F.col("_gt").isNotNull(), on_bad)
    ex = extra_info(split=F.col("split"), index=F.col(index) if index in good.columns else None)
    out = good.select(*rl_row(DS_MATH, with_question(F.col("problem"), INSTR_BOXED), F.col("solution"),
                              F.col("_gt"), ex, keep=[key]))
    return out, bad.drop("_gt")


def norm_append_boxed(df: DataFrame, key="id", solution="plain_solution", answer="short_answer",
                      ds=DS_DEEPSCALER, index="index") -> DataFrame:
    """answer := solution + ' \\boxed{' + answer + '}', truth := answer."""
    full = F.concat(F.col(solution), F.lit(" \\boxed{"), F.col(answer), F.lit("}"))
    ex = extra_info(split=F.col("split"), index=F.col(index) if index in df.columns else None)
    return df.select(*rl_row(ds, with_question(F.col("problem"), INSTR_BOXED), full, F.col(answer), ex, keep=[key]))


def filter_int_answer_words(df: DataFrame, min_words=100, max_words=1000, picked="picked") -> DataFrame:
    """Keep rows whose answer is an integer and whose picked solution has
    ``min_words..max_words`` words (inclusive)."""
    d = df if picked in df.columns else df.withColumn(
        picked, tx.pick_solution("solution", "generations", "correctness_math_verify"))
    wc = tx.word_count(picked)
    ok = (F.coalesce(F.col("answer"), F.lit("")) != "") & tx.is_int_text("answer") & \
        wc.between(min_words, max_words)
    return d.withColumn("n_words", wc).filter(ok)


def norm_multi_gen(df: DataFrame, key="doc_id", min_words=100, max_words=1000, index="index") -> DataFrame:
    """OpenR1-type: filter, then answer := picked solution; data_source forced to MATH."""
    d = filter_int_answer_words(df, min_words, max_words)
    prob = tx.py_strip("problem")
    ex = extra_info(split=F.lit("train"), index=F.col(index) if index in d.columns else None, problem=prob,
                    problem_type=F.col("problem_type"), question_type=F.col("question_type"),
                    source=F.col("source"))
    return d.select(*rl_row(DS_MATH, with_question(prob, INSTR_OPENR1), F.col("picked"),
                            tx.py_strip(F.coalesce(F.col("answer"), F.lit(""))), ex, keep=[key]))


def norm_parity(df: DataFrame, key="doc_id", ds="xor/sequence_8_bitwidth_1", r3: bool = False,
                index: str | None = None) -> DataFrame:
    """Parity text rows: prompt = x + instr (no space; R3 variant adds ' '),
    ground truth = whole answer."""
    content = F.concat(F.col("x_text"), F.lit(" " if r3 else ""), F.lit(INSTR_PARITY))
    ex = extra_info(split=F.col("split"), index=F.col(index) if index else None)
    return df.select(*rl_row(ds, content, F.col("answer"), F.col("answer"), ex, keep=[key]))


def flatten_rl(df: DataFrame, key: str, extra=("split", "index", "question")) -> DataFrame:
    """Scalar view of rl rows (one message prompts) for reports and checks."""
    return df.select(F.col(key), "data_source", F.col("prompt")[0]["role"].alias("role"),
                     F.col("prompt")[0]["content"].alias("content"), F.size("prompt").cast("bigint").alias("n_msgs"),
                     "answer", "ability", F.col("reward_model.style").alias("style"),
                     F.col("reward_model.ground_truth").alias("ground_truth"),
                     *[F.col(f"extra_info.{e}").alias(e) for e in extra])
