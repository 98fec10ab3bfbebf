"""Prefix expansion, portion cut, history bypass and length filter queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from rungkit.functions import text as tx
from rungkit.functions.hashing import uniform
from rungkit.operators import normalize as nz
from rungkit.operators.expand import expand_steps, expand_words_k, expansion_offsets
from rungkit.operators.materialize import materialize
from rungkit.operators.portion import apply_curriculum, cut_modes
from rungkit.operators.project import render_chat
from rungkit.plans.registry import register
from rungkit.plans.sqlutil import hash_extract, last_boxed
from rungkit.sources import views as V

W = V.with_views
MAX_TOKENS = 300


def _train_hash_rows(spark, sf):
    good, _ = nz.norm_hash(V.qa_hash(spark, sf))
    return good.filter(F.col("extra_info.split") == "train")


_G_TRAIN = f""", g AS (
  SELECT id, answer, string_split(answer, chr(10)) AS st FROM qa_hash
  WHERE split = 'train' AND {hash_extract('answer')} IS NOT NULL),
gi AS (SELECT *, sum(len(st) + 1) OVER (ORDER BY id ROWS UNBOUNDED PRECEDING) - (len(st) + 1) AS base_idx FROM g)"""


def _steps_sql(first: int) -> str:
    hi = "len(st)" if first == 0 else "len(st) + 1"
    base_index = "CAST(base_idx + jj + 1 AS BIGINT)" if first == 0 else \
        "CAST(CASE WHEN jj >= 1 THEN base_idx + jj END AS BIGINT)"
    cond = "jj >= 0" if first == 0 else "jj >= 1"
    return W(["qa_hash"], _G_TRAIN + f""",
e AS (SELECT id, st, len(st) AS n, base_idx, unnest(range({first - 1}, {hi})) AS jj FROM gi)
SELECT id, n AS n_steps, jj - ({first - 1}) AS pos, CASE WHEN {cond} THEN jj END AS j,
       CASE WHEN {cond} THEN array_to_string(st[1:jj], chr(10)) END AS partial_answer,
       CASE WHEN {cond} THEN array_to_string(st[jj + 1:], chr(10)) END AS completion,
       CASE WHEN {cond} THEN round(jj / n, 9) END AS portion,
       {base_index} AS "index"
FROM e""")


def _steps(spark, sf, first):
    rows = materialize(_train_hash_rows(spark, sf), "r3_parents")
    n_rows = F.size(F.split("answer", "\n", -1)) + 1     # base row + one row per step, both variants
    ex = expand_steps(expansion_offsets(rows, "id", n_rows), "answer", first_step=first)
    ex = ex.withColumn("index", F.col("_base") + F.col("pos"))
    if first == 1:   # the base row keeps its own (absent) index
        ex = ex.withColumn("index", F.when(F.col("pos") > 0, F.col("index")).otherwise(F.col("extra_info.index")))
    return ex.select("id", "n_steps", "pos", "j", "partial_answer", "completion", "portion", "index")


@register("expand_steps_from0", _steps_sql(0))
def q_expand_steps_from0(spark, sf):
    return _steps(spark, sf, 0)


@register("expand_steps_from1", _steps_sql(1))
def q_expand_steps_from1(spark, sf):
    return _steps(spark, sf, 1)


@register("expand_words_k", W(["qa_boxed"], f""", g AS (
  SELECT id, split, solution, regexp_extract_all(solution, '\\S+') AS w,
         row_number() OVER (PARTITION BY split ORDER BY id) - 1 AS orig_index
  FROM qa_boxed WHERE {last_boxed('solution')} IS NOT NULL),
gi AS (SELECT *, sum(CASE WHEN len(w) > 0 THEN 5 ELSE 1 END)
                   OVER (PARTITION BY split ORDER BY id ROWS UNBOUNDED PRECEDING)
                 - CASE WHEN len(w) > 0 THEN 5 ELSE 1 END AS base_idx FROM g),
e AS (SELECT *, unnest(range(0, CASE WHEN len(w) > 0 THEN 5 ELSE 1 END)) AS jj FROM gi),
c AS (SELECT *, CAST(ceil(jj * len(w) / 4) AS BIGINT) AS cut FROM e)
SELECT id, split, len(w) AS n_words, jj AS pos, CASE WHEN jj > 0 THEN cut END AS cutoff,
       CASE WHEN jj > 0 THEN array_to_string(w[1:cut], ' ') END AS partial_answer,
       CASE WHEN jj > 0 THEN array_to_string(w[cut + 1:], ' ') END AS completion,
       CASE WHEN jj > 0 THEN round(cut / len(w), 9) END AS portion,
       CAST(base_idx + jj AS BIGINT) AS "index", orig_index
FROM c"""))
def q_expand_words_k(spark, sf):
    d = materialize(V.qa_boxed(spark, sf).filter(tx.last_boxed("solution").isNotNull()), "r3_math_parents")
    # one prefix pass per split: first index of each parent's rows and its own position
    d = expansion_offsets(d, "id", F.when(tx.word_count("solution") > 0, 5).otherwise(1), "split",
                          extra={"orig_index": F.lit(1)})
    ex = expand_words_k(d, "solution", k=4).withColumn("index", F.col("_base") + F.col("pos"))
    return ex.select("id", "split", "n_words", "pos", "cutoff", "partial_answer", "completion", "portion",
                     "index", "orig_index")


@register("reindex_expanded", W(["cot"], """, g AS (
  SELECT doc_id, len(string_split(answer, chr(10))) AS n FROM cot),
gi AS (SELECT *, sum(n + 1) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING) - (n + 1) AS base_idx FROM g)
SELECT doc_id, jj AS pos, CAST(base_idx + jj AS BIGINT) AS "index" FROM (SELECT *, unnest(range(0, n + 1)) AS jj FROM gi)"""))
def q_reindex_expanded(spark, sf):
    """Line-step expansion of whole documents, indexed over base + partial rows."""
    docs = expansion_offsets(V.cot(spark, sf), "doc_id", F.size(F.split("answer", "\n", -1)) + 1)
    ex = expand_steps(docs, "answer", first_step=0)
    return ex.select("doc_id", "pos", (F.col("_base") + F.col("pos")).alias("index"))


def _portion_col():
    return F.floor(uniform(F.col("doc_id"), F.lit(32)) * 20) / F.lit(20.0)


_P_SQL = ("floor((('0x' || substr(md5(CAST(doc_id AS VARCHAR) || ':32'), 1, 8))::BIGINT / 4294967296.0) * 20)"
          " / 20.0")


def _cut_sql(mode):
    if mode == "char":
        cut = "CAST(floor(length(answer) * p) AS BIGINT)"
        part, comp = f"substr(answer, 1, {cut})", f"substr(answer, {cut} + 1)"
    else:
        arr = "string_split(answer, chr(10))" if mode == "sep" else "regexp_extract_all(answer, '\\S+\\s*')"
        sep = "chr(10)" if mode == "sep" else "''"
        cut = f"CAST(floor(len({arr}) * p) AS BIGINT)"
        part, comp = f"array_to_string({arr}[1:{cut}], {sep})", f"array_to_string({arr}[{cut} + 1:], {sep})"
    ok = f"(p > 0 AND {part} <> '')"
    return f"""SELECT doc_id, '{mode}' AS mode, p AS portion,
  md5(CASE WHEN {ok} THEN {part} END) AS partial_md5, md5(CASE WHEN {ok} THEN {comp} END) AS completion_md5,
  length(CASE WHEN {ok} THEN {part} END) AS partial_len
FROM (SELECT *, {_P_SQL} AS p FROM cot)"""


@register("cut_by_portion", W(["cot"], "\n" + "\nUNION ALL\n".join(_cut_sql(m) for m in ("char", "sep", "chunk"))))
def q_cut_by_portion(spark, sf):
    """Cut whole documents at a hashed portion in char / line / chunk mode."""
    d = cut_modes(V.cot(spark, sf), "answer", _portion_col(), {"char": "char", "sep": "\n", "chunk": None})
    return d.select("doc_id", "mode", "portion", F.md5("partial_answer").alias("partial_md5"), F.md5("completion").alias("completion_md5"),
                    F.length("partial_answer").cast("bigint").alias("partial_len"))


_FH_P = "floor((('0x' || substr(md5(CAST(id AS VARCHAR) || ':23'), 1, 8))::BIGINT / 4294967296.0) * 20) / 20.0"


@register("filter_history", W(["qa_hash"], _G_TRAIN + f""",
e AS (SELECT id, answer, st, len(st) AS n, unnest(range(-1, len(st))) AS jj FROM gi),
x AS (SELECT id, answer, jj + 1 AS pos, jj >= 0 AS bypass,
             CASE WHEN jj >= 0 THEN array_to_string(st[1:jj], chr(10)) END AS partial_answer,
             CASE WHEN jj >= 0 THEN array_to_string(st[jj + 1:], chr(10)) END AS completion,
             CASE WHEN jj >= 0 THEN jj / n END AS portion0, {_FH_P} AS p FROM e),
y AS (SELECT *, regexp_extract_all(answer, '\\S+\\s*') AS ch FROM x),
z AS (SELECT *, array_to_string(ch[1:CAST(floor(len(ch) * p) AS BIGINT)], '') AS cut,
                array_to_string(ch[CAST(floor(len(ch) * p) AS BIGINT) + 1:], '') AS rest FROM y)
SELECT id, pos, CAST(bypass AS BIGINT) AS bypass, round(CASE WHEN bypass THEN portion0 ELSE p END, 9) AS portion,
       length(CASE WHEN bypass THEN partial_answer WHEN p > 0 AND cut <> '' THEN cut END) AS partial_len,
       length(CASE WHEN bypass THEN completion WHEN p > 0 AND cut <> '' THEN rest END) AS completion_len
FROM z"""))
def q_filter_history(spark, sf):
    """R3 rows with a partial answer bypass the curriculum; base rows get cut."""
    ex = expand_steps(_train_hash_rows(spark, sf), "answer", first_step=0)
    p = F.floor(uniform(F.col("id"), F.lit(23)) * 20) / F.lit(20.0)
    out = apply_curriculum(ex, "answer", p, None)
    return out.select("id", "pos", F.col("bypass"), "portion",
                      F.length("partial_answer").cast("bigint").alias("partial_len"),
                      F.length("completion").cast("bigint").alias("completion_len"))


@register("filter_overlong", W(["qa_hash"], f"""
SELECT id, n_p AS prompt_tokens, n_a AS answer_tokens FROM (
  SELECT id, len(regexp_extract_all('user: ' || question || ' ' || {{instr}} || chr(10) || 'assistant: ', '\\S+')) AS n_p,
         len(regexp_extract_all(answer, '\\S+')) AS n_a
  FROM qa_hash WHERE {hash_extract('answer')} IS NOT NULL)
WHERE n_p + n_a <= {MAX_TOKENS}""".replace("{instr}", "'" + nz.INSTR_HASH.replace("'", "''") + "'")))
def q_filter_overlong(spark, sf):
    """Keep rows whose rendered prompt plus answer fit ``MAX_TOKENS`` tokens."""
    good, _ = nz.norm_hash(V.qa_hash(spark, sf))
    d = good.select("id", tx.word_count(render_chat(F.col("prompt"), True)).cast("bigint").alias("prompt_tokens"),
                    tx.word_count("answer").cast("bigint").alias("answer_tokens"))
    return d.filter(F.col("prompt_tokens") + F.col("answer_tokens") <= MAX_TOKENS)


@register("filter_overlong_report", W(["qa_hash"], f"""
SELECT count(*) AS n_before, count(*) FILTER (WHERE n_p + n_a <= {MAX_TOKENS}) AS n_after,
       count(*) FILTER (WHERE n_p + n_a <= {MAX_TOKENS}) - count(*) AS removed
FROM (
  SELECT len(regexp_extract_all('user: ' || question || ' ' || {{instr}} || chr(10) || 'assistant: ', '\\S+')) AS n_p,
         len(regexp_extract_all(answer, '\\S+')) AS n_a
  FROM qa_hash WHERE {hash_extract('answer')} IS NOT NULL)""".replace("{instr}", "'" + nz.INSTR_HASH.replace("'", "''") + "'")))
def q_filter_overlong_report(spark, sf):
    """Rows before and after the length filter; removed rows as a negative
    number (after - before), as the SFT path reports it."""
    good, _ = nz.norm_hash(V.qa_hash(spark, sf))
    n = tx.word_count(render_chat(F.col("prompt"), True)) + tx.word_count("answer")
    d = good.select(n.alias("_n"))
    kept = F.count(F.when(F.col("_n") <= MAX_TOKENS, 1))
    return d.agg(F.count(F.lit(1)).alias("n_before"), kept.alias("n_after"),
                 (kept - F.count(F.lit(1))).alias("removed"))
