"""Preparation queries: normalisation, answer extraction, rewrites, filters, dedup."""

from __future__ import annotations

from pyspark.sql import functions as F

from rungkit.functions import text as tx
from rungkit.operators import dedup as dd
from rungkit.operators import normalize as nz
from rungkit.operators.ordering import assign_index, take_first_n
from rungkit.operators.project import nested_project, render_chat
from rungkit.operators.summary import misses, rule_summary
from rungkit.plans.registry import register
from rungkit.plans.sqlutil import base7, hash_extract, last_boxed, lit, rewrite_tokens, strip
from rungkit.sources import views as V

W = V.with_views
SUBSET_N = 64


def _hash_rows_sql(src: str, instr: str = nz.INSTR_HASH) -> str:
    return f"""
SELECT id, {lit(nz.DS_GSM8K)} AS data_source, 'user' AS role, question || ' ' || {lit(instr)} AS content,
       CAST(1 AS BIGINT) AS n_msgs, answer, 'math' AS ability, 'rule' AS style, {hash_extract('answer')} AS ground_truth,
       split, question
FROM {src} WHERE {hash_extract('answer')} IS NOT NULL"""


@register("norm_hash", W(["qa_hash"], _hash_rows_sql("qa_hash")))
def q_norm_hash(spark, sf):
    good, _ = nz.norm_hash(V.qa_hash(spark, sf))
    return nz.flatten_rl(good, "id", extra=("split", "question"))


@register("norm_hash_subset", W(["qa_hash"], f""", sub AS (
  (SELECT * FROM qa_hash WHERE split = 'train' ORDER BY id LIMIT {SUBSET_N})
  UNION ALL (SELECT * FROM qa_hash WHERE split = 'test'))""" + _hash_rows_sql("sub")))
def q_norm_hash_subset(spark, sf):
    """First ``SUBSET_N`` train rows (key order), test unchanged."""
    qa = V.qa_hash(spark, sf)
    sub = take_first_n(qa.filter("split = 'train'"), "id", SUBSET_N, strict=False).unionByName(qa.filter("split = 'test'"))
    good, _ = nz.norm_hash(sub)
    return nz.flatten_rl(good, "id", extra=("split", "question"))


@register("extract_hash_answer", W(["qa_hash"], f"""
SELECT split, count(*) AS n_rows, count(gt) AS hits, count(*) - count(gt) AS misses,
       count(DISTINCT gt) AS distinct_answers
FROM (SELECT split, {hash_extract('answer')} AS gt FROM qa_hash) GROUP BY split"""))
def q_extract_hash_answer(spark, sf):
    """Per-split extraction summary (rows, hits, misses, distinct answers)."""
    d = V.qa_hash(spark, sf).withColumn("gt", tx.extract_hash_answer("answer"))
    return d.groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"), F.count("gt").alias("hits"),
                                  (F.count(F.lit(1)) - F.count("gt")).alias("misses"),
                                  F.countDistinct("gt").alias("distinct_answers"))


@register("extract_boxed_answer", W(["qa_boxed"], f"""
SELECT id, {last_boxed('solution')} AS boxed FROM qa_boxed"""))
def q_extract_boxed_answer(spark, sf):
    return V.qa_boxed(spark, sf).select("id", tx.last_boxed("solution").alias("boxed"))


_BOXED_ROWS = f""", b AS (SELECT id, split, {last_boxed('solution')} AS boxed FROM qa_boxed)"""


@register("extract_boxed_summary", W(["qa_boxed"], _BOXED_ROWS + """
SELECT split, count(*) AS n_rows, count(boxed) AS hits, count(*) - count(boxed) AS misses,
       count(DISTINCT boxed) AS distinct_answers FROM b GROUP BY split"""))
def q_extract_boxed_summary(spark, sf):
    d = V.qa_boxed(spark, sf).select("split", tx.last_boxed("solution").alias("boxed"))
    return rule_summary(d, ["split"], F.col("boxed").isNotNull(), answer=F.col("boxed"))


@register("extract_boxed_misses", W(["qa_boxed"], _BOXED_ROWS + """
SELECT id, split FROM b WHERE boxed IS NULL"""))
def q_extract_boxed_misses(spark, sf):
    """Quarantine of rows without a boxed answer."""
    d = V.qa_boxed(spark, sf).select("id", "split", tx.last_boxed("solution").alias("boxed"))
    return misses(d, F.col("boxed").isNotNull()).select("id", "split")


@register("norm_boxed", W(["qa_boxed"], f""", g AS (
  SELECT *, {last_boxed('solution')} AS gt FROM qa_boxed)
SELECT id, {lit(nz.DS_MATH)} AS data_source, 'user' AS role, problem || ' ' || {lit(nz.INSTR_BOXED)} AS content,
       CAST(1 AS BIGINT) AS n_msgs, solution AS answer, 'math' AS ability, 'rule' AS style, gt AS ground_truth, split,
       row_number() OVER (PARTITION BY split ORDER BY id) - 1 AS "index"
FROM g WHERE gt IS NOT NULL"""))
def q_norm_boxed(spark, sf):
    raw = V.qa_boxed(spark, sf)
    d = raw.filter(tx.last_boxed("solution").isNotNull())
    d = assign_index(d, "id", partition_by="split", out="index")
    good, _ = nz.norm_boxed(d)
    return nz.flatten_rl(good, "id", extra=("split", "index"))


@register("norm_append_boxed", W(["qa_boxed"], f""", ix AS (
  SELECT *, row_number() OVER (PARTITION BY split ORDER BY id) - 1 AS idx FROM qa_boxed)
SELECT id, ds AS data_source, 'user' AS role, problem || ' ' || {lit(nz.INSTR_BOXED)} AS content, CAST(1 AS BIGINT) AS n_msgs,
       plain_solution || ' \\boxed{{' || short_answer || '}}' AS answer, 'math' AS ability, 'rule' AS style,
       short_answer AS ground_truth, split, idx AS "index"
FROM ix CROSS JOIN (VALUES ({lit(nz.DS_DEEPSCALER)}), ({lit(nz.DS_OPENMATH_FORCED)})) v(ds)"""))
def q_norm_append_boxed(spark, sf):
    """DeepScaleR- and OpenMath-type rows (the latter with its forced data source)."""
    d = assign_index(V.qa_boxed(spark, sf), "id", partition_by="split", out="index")
    a = nz.norm_append_boxed(d, ds=nz.DS_DEEPSCALER)
    b = nz.norm_append_boxed(d, ds=nz.DS_OPENMATH_FORCED)
    return nz.flatten_rl(a.unionByName(b), "id", extra=("split", "index"))


def _pick_sql(g="generations", f="correctness_math_verify", s="solution"):
    nb = lambda x: f"{strip(x)} <> ''"
    first_flag = (f"list_filter(list_transform(range(1, least(len(coalesce({g}, [])), len(coalesce({f}, []))) + 1), "
                  f"lambda i: CASE WHEN {f}[i] AND {nb(g + '[i]')} THEN i END), lambda x: x IS NOT NULL)[1]")
    first_nb = f"list_filter(coalesce({g}, []), lambda x: {nb('x')})[1]"
    return (f"coalesce(nullif({strip(f'coalesce({s}, {lit(chr(32)*0)})')}, ''), {strip(f'{g}[{first_flag}]')}, "
            f"{strip(first_nb)}, '')")


@register("pick_solution", W(["multi_gen"], f"""
SELECT doc_id, {_pick_sql()} AS picked FROM multi_gen"""))
def q_pick_solution(spark, sf):
    d = V.multi_gen(spark, sf)
    return d.select("doc_id", tx.pick_solution("solution", "generations", "correctness_math_verify").alias("picked"))


@register("pick_solution_summary", W(["multi_gen"], f""", p AS (SELECT source, {_pick_sql()} AS picked FROM multi_gen)
SELECT source, count(*) AS n_rows, count(*) FILTER (WHERE picked <> '') AS hits,
       count(*) FILTER (WHERE picked = '') AS misses FROM p GROUP BY source"""))
def q_pick_solution_summary(spark, sf):
    d = V.multi_gen(spark, sf)
    d = d.select("source", tx.pick_solution("solution", "generations", "correctness_math_verify").alias("picked"))
    return rule_summary(d, ["source"], F.col("picked") != "")


_WC = "len(regexp_extract_all(picked, '\\S+'))"
_INT = (f"(regexp_matches({strip('answer')}, '^[+-]?[0-9]+$') "
        f"AND TRY_CAST({strip('answer')} AS BIGINT) IS NOT NULL)")


@register("filter_int_answer_words", W(["multi_gen"], f""", p AS (SELECT *, {_pick_sql()} AS picked FROM multi_gen)
SELECT doc_id, {_WC} AS n_words FROM p
WHERE coalesce(answer, '') <> '' AND {_INT} AND {_WC} BETWEEN 100 AND 1000"""))
def q_filter_int_answer_words(spark, sf):
    return nz.filter_int_answer_words(V.multi_gen(spark, sf)).select("doc_id", "n_words")


@register("norm_multi_gen", W(["multi_gen"], f""", p AS (SELECT *, {_pick_sql()} AS picked FROM multi_gen),
k AS (SELECT * FROM p WHERE coalesce(answer, '') <> '' AND {_INT} AND {_WC} BETWEEN 100 AND 1000)
SELECT doc_id, {lit(nz.DS_MATH)} AS data_source, 'user' AS role,
       {strip('problem')} || ' ' || {lit(nz.INSTR_OPENR1)} AS content, CAST(1 AS BIGINT) AS n_msgs, picked AS answer,
       'math' AS ability, 'rule' AS style, {strip("coalesce(answer, '')")} AS ground_truth, 'train' AS split,
       row_number() OVER (ORDER BY doc_id) - 1 AS "index", {strip('problem')} AS problem,
       problem_type, question_type, source
FROM k"""))
def q_norm_multi_gen(spark, sf):
    d = nz.filter_int_answer_words(V.multi_gen(spark, sf))
    d = assign_index(d, "doc_id", out="index")
    out = nz.norm_multi_gen(d)
    return nz.flatten_rl(out, "doc_id", extra=("split", "index", "problem", "problem_type", "question_type",
                                               "source"))


_B7 = lambda t: base7(f"CAST({t} AS BIGINT)")
_M7 = lambda t: f"CAST(CAST({t} AS BIGINT) % 7 AS VARCHAR)"


@register("base7_rewrite", W(["cot"], f"""
SELECT doc_id, {rewrite_tokens('answer', _B7)} AS rewritten,
       len(regexp_extract_all(answer, '\\b\\d{{1,6}}\\b')) AS n_tokens
FROM cot"""))
def q_base7_rewrite(spark, sf):
    d = V.cot(spark, sf)
    return d.select("doc_id", tx.base7_rewrite("answer").alias("rewritten"),
                    tx.int_token_count("answer").alias("n_tokens"))


@register("base7_rewrite_summary", W(["cot"], """, n AS (
  SELECT source, len(regexp_extract_all(answer, '\\b\\d{1,6}\\b')) AS n FROM cot)
SELECT source, count(*) AS n_rows, count(*) FILTER (WHERE n > 0) AS hits,
       count(*) FILTER (WHERE NOT coalesce(n > 0, false)) AS misses,
       CAST(coalesce(sum(n), 0) AS BIGINT) AS n_tokens FROM n GROUP BY source"""))
def q_base7_rewrite_summary(spark, sf):
    """Numbers rewritten, by source (the same for base 7 and modulo 7)."""
    d = V.cot(spark, sf).select("source", tx.int_token_count("answer").alias("n"))
    return rule_summary(d, ["source"], F.col("n") > 0, tokens=F.col("n"))


@register("mod7_rewrite", W(["cot"], f"""
SELECT doc_id, {rewrite_tokens('answer', _M7)} AS rewritten FROM cot"""))
def q_mod7_rewrite(spark, sf):
    return V.cot(spark, sf).select("doc_id", tx.mod7_rewrite("answer").alias("rewritten"))


def _b7_signed(v):
    return f"CASE WHEN {v} < 0 THEN '-' || {base7(f'abs({v})')} ELSE {base7(v)} END"


@register("base7_final_answer", W(["qa_hash"], f""", m AS (
  SELECT id, answer, regexp_extract(answer, '#### (-?[0-9.,]+)', 1) AS num,
         instr(answer, regexp_extract(answer, '#### -?[0-9.,]+', 0)) + 5 AS pos FROM qa_hash)
SELECT id, CASE WHEN num = '' THEN answer
                ELSE substr(answer, 1, pos - 1) || {_b7_signed("CAST(replace(num, ',', '') AS BIGINT)")}
                     || substr(answer, pos + length(num)) END AS rewritten
FROM m"""))
def q_base7_final_answer(spark, sf):
    return V.qa_hash(spark, sf).select("id", tx.base7_final_answer("answer").alias("rewritten"))


@register("filter_integer_only", W(["qa_hash"], """
SELECT id, split FROM qa_hash
WHERE NOT (regexp_matches(question, '\\d+\\.\\d+') OR regexp_matches(answer, '\\d+\\.\\d+'))"""))
def q_filter_integer_only(spark, sf):
    d = V.qa_hash(spark, sf)
    return d.filter(~(tx.has_decimal("question") | tx.has_decimal("answer"))).select("id", "split")


@register("norm_base7", W(["qa_hash"], f""", f AS (
  SELECT * FROM qa_hash WHERE NOT (regexp_matches(question, '\\d+\\.\\d+') OR regexp_matches(answer, '\\d+\\.\\d+'))),
r AS (SELECT id, split, {rewrite_tokens('question', _B7)} AS q7, {rewrite_tokens('answer', _B7)} AS a7 FROM f),
t AS (SELECT *, {hash_extract('a7')} AS raw FROM r)
SELECT id, {lit(nz.DS_GSM8K)} AS data_source, 'user' AS role, q7 || ' ' || {lit(nz.INSTR_BASE7)} AS content,
       CAST(1 AS BIGINT) AS n_msgs, a7 AS answer, 'math' AS ability, 'rule' AS style,
       CASE WHEN regexp_matches(raw, '^[+-]?[0-9]+$') THEN CAST(CAST(raw AS BIGINT) AS VARCHAR) ELSE raw END
         AS ground_truth, split, q7 AS question
FROM t WHERE raw IS NOT NULL"""))
def q_norm_base7(spark, sf):
    good, _ = nz.norm_base7(V.qa_hash(spark, sf))
    return nz.flatten_rl(good, "id", extra=("split", "question"))


@register("nested_project", W(["qa_hash"], f"""
SELECT id, question AS question, question || ' ' || {lit(nz.INSTR_HASH)} AS prompt_text,
       {hash_extract('answer')} AS truth
FROM qa_hash WHERE {hash_extract('answer')} IS NOT NULL"""))
def q_nested_project(spark, sf):
    """Pick prompt/response fields of rl rows by key paths (length-1 lists unwrapped)."""
    good, _ = nz.norm_hash(V.qa_hash(spark, sf))
    return nested_project(good, {"question": ("extra_info", ["question"]),
                                 "prompt_text": ("prompt", ["content"]),
                                 "truth": ("reward_model", ["ground_truth"])}, keep=["id"])


@register("render_chat", W(["chats"], """
SELECT conv_id,
       array_to_string(list_transform(prompt, lambda m: m.role || ': ' || m.content || chr(10)), '') || 'assistant: '
         AS rendered,
       array_to_string(list_transform(prompt, lambda m: m.role || ': ' || m.content || chr(10)), '') AS rendered_no_gen
FROM chats"""))
def q_render_chat(spark, sf):
    c = V.chats(spark, sf)
    return c.select("conv_id", render_chat(F.col("prompt"), True).alias("rendered"),
                    render_chat(F.col("prompt"), False).alias("rendered_no_gen"))


@register("dedup_first_prompt", """
SELECT min(doc_id) AS doc_id FROM documents GROUP BY text""")
def q_dedup_first_prompt(spark, sf):
    return dd.dedup_first(V.prompts(spark, sf), "doc_id").select("doc_id")


@register("dedup_first_prompt_chats", W(["chats"], """
SELECT min(conv_id) AS conv_id FROM chats GROUP BY prompt[1].content"""))
def q_dedup_first_prompt_chats(spark, sf):
    """Chat prompts keyed by the first message: rows sharing a system turn collapse."""
    return dd.dedup_first(V.chats(spark, sf), "conv_id").select("conv_id")


@register("dedup_report", """
SELECT count(*) AS original, count(DISTINCT text) AS kept, count(*) - count(DISTINCT text) AS removed,
       round((count(*) - count(DISTINCT text)) * 100.0 / nullif(count(*), 0), 2) AS reduction_pct
FROM documents""")
def q_dedup_report(spark, sf):
    return dd.dedup_counts(V.prompts(spark, sf))
