"""Sequence-building queries (ops 62-66)."""

from __future__ import annotations

from pyspark.sql import functions as F

from rungkit.operators import normalize as nz
from rungkit.operators import sequences as sq
from rungkit.operators.expand import expand_steps
from rungkit.operators.materialize import materialize
from rungkit.operators.ordering import assign_index
from rungkit.operators.project import render_chat
from rungkit.plans.registry import register
from rungkit.plans.sqlutil import hash_extract, lit
from rungkit.sources import views as V

W = V.with_views
MAX_LEN = 256
MAX_PROMPT = 128
REPORT_BATCH = 32
POLICIES = ("right", "left", "error")


@register("vocab_build", """
SELECT token, count(*) AS count, row_number() OVER (ORDER BY count(*) DESC, token) + 1 AS id
FROM (SELECT unnest(regexp_extract_all(text, '\\S+')) AS token FROM documents) GROUP BY token""")
def q_vocab_build(spark, sf):
    """Dense vocabulary of the whole documents corpus."""
    return sq.vocab_build(V.table(spark, sf, "documents"), "text")


def _qa(spark, sf):
    good, _ = nz.norm_hash(V.qa_hash(spark, sf))
    return good.select("id", render_chat(F.col("prompt"), True).alias("prompt_text"), "answer")


def _encoded(spark, sf):
    qa = materialize(_qa(spark, sf), "sft_pairs")
    vocab = materialize(sq.vocab_build(qa, ["prompt_text", "answer"]), "vocab")
    return sq.encode_many(qa, "id", {"prompt_ids": F.col("prompt_text"), "response_ids": F.col("answer")}, vocab)


_QA_SQL = f""", qa AS (
  SELECT id, 'user: ' || question || ' ' || {lit(nz.INSTR_HASH)} || chr(10) || 'assistant: ' AS prompt_text, answer
  FROM qa_hash WHERE {hash_extract('answer')} IS NOT NULL),
toks AS (
  SELECT id, 'p' AS part, unnest(regexp_extract_all(prompt_text, '\\S+')) AS token,
         generate_subscripts(regexp_extract_all(prompt_text, '\\S+'), 1) AS pos FROM qa
  UNION ALL
  SELECT id, 'r', unnest(regexp_extract_all(answer, '\\S+')), generate_subscripts(regexp_extract_all(answer, '\\S+'), 1)
  FROM qa),
vocab AS (SELECT token, row_number() OVER (ORDER BY count(*) DESC, token) + 1 AS tid FROM toks GROUP BY token),
enc AS (
  SELECT q.id,
         coalesce((SELECT list(v.tid ORDER BY t.pos) FROM toks t JOIN vocab v USING (token)
                   WHERE t.id = q.id AND t.part = 'p'), []) AS p,
         coalesce((SELECT list(v.tid ORDER BY t.pos) FROM toks t JOIN vocab v USING (token)
                   WHERE t.id = q.id AND t.part = 'r'), []) AS r
  FROM qa q),
seq AS (SELECT id, p, r, len(p) AS pl, len(r) + 1 AS rl, p || r || [1] AS ids FROM enc)"""


def _s(e):
    return f"array_to_string(list_transform({e}, lambda x: CAST(x AS VARCHAR)), ' ')"


def _sft_sql(policy):
    L = MAX_LEN
    t = {"right": f"CASE WHEN len(ids) > {L} THEN ids[1:{L}] ELSE ids END",
         "left": f"CASE WHEN len(ids) > {L} THEN ids[len(ids) - {L} + 1:] ELSE ids END",
         "error": "ids"}[policy]
    where = f"WHERE len(ids) <= {L}" if policy == "error" else ""
    return f"""SELECT id, '{policy}' AS policy,
  {_s(f"t || list_transform(range(0, {L} - len(t)), lambda x: 0)")} AS input_ids,
  {_s(f"list_transform(range(0, {L}), lambda i: CASE WHEN i < len(t) THEN 1 ELSE 0 END)")} AS attention_mask,
  {_s(f"list_transform(range(0, {L}), lambda i: least(i, len(t) - 1))")} AS position_ids,
  {_s(f'''list_transform(range(0, {L}), lambda i: CASE WHEN pl > 1 AND i < least(pl, {L}) - 1 THEN 0
        WHEN i = least(pl + rl, {L}) - 1 THEN 0 WHEN i < len(t) THEN 1 ELSE 0 END)''')} AS loss_mask
FROM (SELECT *, {t} AS t FROM seq {where})"""


def _sft_frames(spark, sf, policies=POLICIES):
    """One pass: every row once per policy (policy is a column)."""
    e = _encoded(spark, sf)
    e = e.select("*", F.explode(F.array(*[F.lit(p) for p in policies])).alias("policy"))
    return sq.sft_sequences(e, "prompt_ids", "response_ids", MAX_LEN, F.col("policy"))


@register("sft_sequences", W(["qa_hash"], _QA_SQL + "\n" + "\nUNION ALL\n".join(_sft_sql(p) for p in POLICIES)))
def q_sft_sequences(spark, sf):
    """Right-padded SFT rows under the three truncation policies (over-long
    rows of the 'error' policy are quarantined)."""
    kept, _ = _sft_frames(spark, sf)
    return kept.select("id", "policy", sq.ids_text("input_ids").alias("input_ids"),
                       sq.ids_text("attention_mask").alias("attention_mask"),
                       sq.ids_text("position_ids").alias("position_ids"), sq.ids_text("loss_mask").alias("loss_mask"))


@register("sft_padding_report", W(["qa_hash"], _QA_SQL + f"""
, b AS (SELECT (row_number() OVER (ORDER BY id) - 1) // {REPORT_BATCH} AS batch, len(ids) AS n, least(len(ids), {MAX_LEN}) AS k FROM seq)
SELECT batch, count(*) AS n_rows, count(*) FILTER (WHERE n > {MAX_LEN}) AS n_truncated, CAST(sum(k) AS BIGINT) AS tokens,
       CAST(sum(n - k) AS BIGINT) AS tokens_lost, CAST(max(k) AS BIGINT) AS longest,
       round(1 - sum(k) / (count(*) * {MAX_LEN}), 9) AS waste_fixed, round(1 - sum(k) / (count(*) * max(k)), 9) AS waste_dynamic
FROM b GROUP BY batch"""))
def q_sft_padding_report(spark, sf):
    """Truncation and padding waste per batch of rows in id order."""
    e = assign_index(_encoded(spark, sf), "id", out="row")
    e = e.withColumn("batch", F.floor(F.col("row") / REPORT_BATCH))
    return sq.padding_report(e, "batch", F.size("prompt_ids") + F.size("response_ids") + 1, MAX_LEN)


@register("truncate_policy", W(["qa_hash"], _QA_SQL + f"""
SELECT policy, count(*) AS n_rows, count(*) FILTER (WHERE len(ids) > {MAX_LEN} AND policy <> 'error') AS n_truncated,
       count(*) FILTER (WHERE len(ids) > {MAX_LEN} AND policy = 'error') AS n_quarantined
FROM seq, (SELECT unnest(['right', 'left', 'error']) AS policy) GROUP BY policy"""))
def q_truncate_policy(spark, sf):
    """Rows, truncated rows and quarantined rows per truncation policy."""
    kept, bad = _sft_frames(spark, sf)
    full = F.size("prompt_ids") + F.size("response_ids") + 1 > MAX_LEN
    rows = kept.select("policy", full.alias("over"), F.lit(False).alias("out")).unionByName(
        bad.select("policy", full.alias("over"), F.lit(True).alias("out")))
    return rows.groupBy("policy").agg(F.count(F.lit(1)).alias("n_rows"), F.count(F.when(F.col("over") & ~F.col("out"), 1)).alias("n_truncated"),
                                      F.count(F.when(F.col("out"), 1)).alias("n_quarantined"))


@register("position_ids", W(["qa_hash"], _QA_SQL + f"""
SELECT id, {_s(f"list_transform(range(1, {MAX_LEN} + 1), lambda i: greatest(list_sum(list_transform(range(1, i + 1), lambda j: CASE WHEN j <= len(t) THEN 1 ELSE 0 END)) - 1, 0))")} AS position_ids
FROM (SELECT *, CASE WHEN len(ids) > {MAX_LEN} THEN ids[1:{MAX_LEN}] ELSE ids END AS t FROM seq)"""))
def q_position_ids(spark, sf):
    """Positions from attention masks by the general running-sum rule."""
    kept, _ = _sft_frames(spark, sf, ("right",))
    return kept.select("id", sq.ids_text(sq.position_ids(F.col("attention_mask"))).alias("position_ids"))


@register("rl_prompt_tokens", W(["qa_hash"], f""", g AS (
  SELECT id, question, answer, string_split(answer, chr(10)) AS st FROM qa_hash
  WHERE split = 'train' AND {hash_extract('answer')} IS NOT NULL),
e AS (SELECT id, question, st, unnest(range(-1, len(st))) AS jj FROM g),
x AS (SELECT id, jj + 1 AS pos,
             'user: ' || question || ' ' || {lit(nz.INSTR_HASH)} || chr(10) || 'assistant: ' ||
             CASE WHEN jj >= 0 THEN array_to_string(st[1:jj], chr(10)) ELSE '' END AS txt FROM e),
toks AS (SELECT id, pos, unnest(regexp_extract_all(txt, '\\S+')) AS token,
                generate_subscripts(regexp_extract_all(txt, '\\S+'), 1) AS k FROM x),
vocab AS (SELECT token, row_number() OVER (ORDER BY count(*) DESC, token) + 1 AS tid FROM toks GROUP BY token),
enc AS (SELECT t.id, t.pos, list(v.tid ORDER BY t.k) AS ids FROM toks t JOIN vocab v USING (token) GROUP BY t.id, t.pos),
tr AS (SELECT id, pos, len(ids) AS raw_len,
              CASE WHEN len(ids) > {MAX_PROMPT} THEN ids[len(ids) - {MAX_PROMPT} + 1:] ELSE ids END AS t FROM enc)
SELECT id, pos, raw_len,
  {_s(f"list_transform(range(0, {MAX_PROMPT} - len(t)), lambda x: 0) || t")} AS input_ids,
  {_s(f"list_transform(range(0, {MAX_PROMPT}), lambda i: CASE WHEN i >= {MAX_PROMPT} - len(t) THEN 1 ELSE 0 END)")}
    AS attention_mask,
  {_s(f"list_transform(range(0, {MAX_PROMPT}), lambda i: greatest(i - ({MAX_PROMPT} - len(t)), 0))")} AS position_ids
FROM tr"""))
def q_rl_prompt_tokens(spark, sf):
    """Left-padded prompt tokens of R3 rows: chats rendered with the partial
    answer as an open assistant turn (or a generation prompt)."""
    good, _ = nz.norm_hash(V.qa_hash(spark, sf))
    ex = expand_steps(good.filter(F.col("extra_info.split") == "train"), "answer", first_step=0)
    ex = ex.withColumn("rid", F.struct("id", "pos"))
    ex = materialize(ex.withColumn("txt", render_chat(F.col("prompt"), True, F.col("partial_answer")))
                     .select("id", "pos", "rid", "txt"), "rl_prompts")
    vocab = materialize(sq.vocab_build(ex, "txt"), "vocab")
    enc = sq.encode(ex, "rid", F.col("txt"), vocab, "ids")
    rl = sq.rl_prompt_tokens(enc, "ids", MAX_PROMPT, "left")
    return rl.select("id", "pos", F.size("raw_prompt_ids").cast("bigint").alias("raw_len"),
                     sq.ids_text("input_ids").alias("input_ids"), sq.ids_text("attention_mask").alias("attention_mask"),
                     sq.ids_text("position_ids").alias("position_ids"))
