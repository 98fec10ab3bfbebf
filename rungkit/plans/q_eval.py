"""Evaluation queries (ops 5, 54-61)."""

from __future__ import annotations

from pyspark.sql import functions as F

from rungkit.functions import scoring as sc
from rungkit.functions import text as tx
from rungkit.operators import curriculum as cur
from rungkit.operators import evaluate as ev
from rungkit.operators.materialize import materialize
from rungkit.operators import normalize as nz
from rungkit.operators.normalize import INSTR_HASH
from rungkit.plans.registry import register
from rungkit.plans.sqlutil import hash_extract, last_boxed, lit
from rungkit.session import scratch_path
from rungkit.sources import views as V
from rungkit.sources.io import eval_records, read_eval_jsonl, write_eval_records

W = V.with_views
N_MAX = 20
K_MAX = 8
RATIOS = [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]


def _pk_sql(n="n", c="c", k="k"):
    return (f"CASE WHEN {c} = 0 OR {n} < {k} THEN 0.0 WHEN {c} = {n} THEN 1.0 ELSE 1.0 - list_reduce("
            f"list_transform(range({n} - {c} + 1, {n} + 1), lambda i: 1.0 - {k} / i), lambda a, b: a * b) END")


_COUNTS = """, counts AS (
  SELECT problem_id, count(*) AS n, count(*) FILTER (WHERE reward > 0) AS c FROM rollouts GROUP BY problem_id),
per AS (SELECT problem_id, n, c, unnest(range(1, least(%d, n) + 1)) AS k FROM counts)""" % N_MAX


@register("passk_per_problem", W(["rollouts"], _COUNTS + f"""
SELECT problem_id, n, c, k, round({_pk_sql()}, 9) AS passk FROM per"""))
def q_passk_per_problem(spark, sf):
    counts = ev.problem_counts(V.rollouts(spark, sf), "problem_id")
    return ev.passk_per_problem(counts, "problem_id", N_MAX).select("problem_id", "n", "c", "k", "passk")


@register("passk_curve", W(["rollouts"], _COUNTS + f"""
SELECT k, round(avg({_pk_sql()}), 9) AS passk, count(*) AS n_problems FROM per GROUP BY k"""))
def q_passk_curve(spark, sf):
    counts = ev.problem_counts(V.rollouts(spark, sf), "problem_id")
    return ev.passk_curve(counts, N_MAX)


@register("passk_compare", W(["labelled_rollouts"], f""", counts AS (
  SELECT label, problem_id, count(*) AS n, count(*) FILTER (WHERE reward > 0) AS c
  FROM labelled_rollouts GROUP BY label, problem_id),
per AS (SELECT label, n, c, unnest(range(1, least({N_MAX}, n) + 1)) AS k FROM counts)
SELECT label, k, round(avg({_pk_sql()}), 9) AS passk, count(*) AS n_problems FROM per WHERE k <= {K_MAX}
GROUP BY label, k"""))
def q_passk_compare(spark, sf):
    """pass@k curves of several labelled result sets, k <= K_MAX."""
    counts = ev.problem_counts(V.labelled_rollouts(spark, sf), "problem_id", by=["label"])
    return ev.passk_curve(counts, N_MAX, by=["label"]).filter(F.col("k") <= K_MAX)


@register("pair_outputs", W(["rollouts"], """
SELECT r.problem_id, o.o_orderpriority AS ground_truth, r.sample_no, r.reward
FROM orders o JOIN rollouts r ON r.problem_id = o.o_orderkey"""))
def q_pair_outputs(spark, sf):
    """Problems paired with their generations by problem id (an equi-join,
    not a positional zip)."""
    o = V.table(spark, sf, "orders").select(F.col("o_orderkey").alias("problem_id"),
                                            F.col("o_orderpriority").alias("ground_truth"))
    return o.join(V.rollouts(spark, sf), "problem_id").select("problem_id", "ground_truth", "sample_no", "reward")


_QA_SCORED = f""", sc AS (
  SELECT r.id, r.sample_no, r.completion, {hash_extract('q.answer')} AS truth,
         CAST(CASE WHEN coalesce({hash_extract('r.completion')}, {last_boxed('r.completion')}) = {hash_extract('q.answer')} THEN 1 ELSE 0 END AS DOUBLE) AS reward
  FROM qa_rollouts r JOIN qa_hash q ON q.id = r.id WHERE {hash_extract('q.answer')} IS NOT NULL)"""


@register("eval_jsonl", W(["qa_rollouts"], _QA_SCORED + f""",
per AS (SELECT id, any_value(truth) AS truth, list(completion ORDER BY sample_no) AS cs, list(reward ORDER BY sample_no) AS rs,
               count(*) AS n, CAST(sum(reward) AS BIGINT) AS c FROM sc GROUP BY id)
SELECT p.id, md5(question || ' ' || {lit(INSTR_HASH)}) AS prompt_md5, 'user' AS role, truth AS ground_truth,
       md5(array_to_string(cs, chr(30))) AS completions_md5,
       array_to_string(list_transform(rs, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ',') AS rewards,
       array_to_string(list_transform(rs, lambda x: CAST(x > 0 AS VARCHAR)), ',') AS successes,
       array_to_string(list_transform(range(1, least(n, {N_MAX}) + 1), lambda k: CAST(CAST(round(1000000 * ({_pk_sql()})) AS BIGINT) AS VARCHAR)), ',') AS pass_at
FROM per p JOIN qa_hash q ON q.id = p.id"""))
def q_eval_jsonl(spark, sf):
    """Evaluation records of normalised problems and their completions, scored,
    written as JSON lines and read back with a schema; all fields, as text."""
    qa = V.qa_hash(spark, sf)
    problems = nz.norm_hash(qa)[0].select("id", "data_source", "prompt", F.col("reward_model.ground_truth").alias("ground_truth"))
    bindings = sc.bindings_table(spark)
    path = scratch_path(spark, "eval_jsonl")
    records = eval_records(problems, V.qa_rollouts(spark, sf), "id", N_MAX, lambda d: sc.score_bound(sc.bound(d, bindings)))
    write_eval_records(records, path)
    back = read_eval_jsonl(spark, path)
    text = lambda c, f: F.array_join(F.transform(c, f), ",")
    ks = F.sequence(F.lit(1), F.size("pass@k"))
    return back.select("id", F.md5(F.col("prompt")[0]["content"]).alias("prompt_md5"), F.col("prompt")[0]["role"].alias("role"), "ground_truth",
                       F.md5(F.array_join("completions", "\x1e")).alias("completions_md5"),
                       text("rewards", lambda x: x.cast("bigint").cast("string")).alias("rewards"),
                       text("successes", lambda x: x.cast("string")).alias("successes"),
                       text(F.transform(ks, lambda k: F.element_at(F.col("`pass@k`"), k.cast("string"))),
                            lambda v: F.round(v * 1000000).cast("bigint").cast("string")).alias("pass_at"))


def _ledger(spark, sf):
    # read by several aggregations: written once
    return materialize(cur.attempt_ledger(V.attempts_train(spark, sf)), "ledger")


_LEDGER_SQL = """, flagged AS (
  SELECT *, CASE WHEN lag(portion) OVER w IS NULL OR lag(portion) OVER w <> portion THEN 1 ELSE 0 END AS chg
  FROM attempts_train WINDOW w AS (PARTITION BY sample_id ORDER BY step, pos)),
runs AS (SELECT *, CAST(sum(chg) OVER (PARTITION BY sample_id ORDER BY step, pos ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run_id
         FROM flagged),
ledger AS (SELECT sample_id, run_id - 1 AS t, min(portion) AS portion, avg(reward) AS reward
           FROM runs GROUP BY sample_id, run_id),
lens AS (SELECT sample_id, max(t) + 1 AS r FROM ledger GROUP BY sample_id),
tmax AS (SELECT max(r) AS tt FROM lens),
grid AS (SELECT u.sample_id, l.r, unnest(range(0, (SELECT tt FROM tmax))) AS t
         FROM (SELECT DISTINCT sample_id FROM attempts) u LEFT JOIN lens l USING (sample_id)),
mat AS (SELECT g.sample_id, g.t, d.portion, d.reward FROM grid g
        LEFT JOIN ledger d ON d.sample_id = g.sample_id AND d.t = least(g.t, g.r - 1))"""


@register("trajectory_matrix", W(["attempts_train"], _LEDGER_SQL + """
SELECT sample_id, t, portion, round(reward, 9) AS reward FROM mat"""))
def q_trajectory_matrix(spark, sf):
    return ev.trajectory_matrix(_ledger(spark, sf), V.attempts(spark, sf))


@register("trajectory_runs", W(["attempts_train"], _LEDGER_SQL + """
SELECT d.sample_id, d.t AS t_from, CASE WHEN d.t < l.r - 1 THEN d.t END AS t_to, d.portion, round(d.reward, 9) AS reward
FROM ledger d JOIN lens l USING (sample_id)"""))
def q_trajectory_runs(spark, sf):
    """Trajectories as runs; a sample's last run has no end."""
    return ev.trajectory_runs(_ledger(spark, sf))


@register("trajectory_bands", W(["attempts_train"], _LEDGER_SQL + """, b AS (
  SELECT t, count(portion) AS n, avg(portion) AS pm, stddev_pop(portion) AS ps, avg(reward) AS rm,
         stddev_pop(reward) AS rs
  FROM mat GROUP BY t)
SELECT t, n, round(pm, 9) AS portion_mean, round(ps, 9) AS portion_std,
       round(greatest(pm - ps, 0.0), 9) AS portion_lo, round(least(pm + ps, 1.0), 9) AS portion_hi,
       round(rm, 9) AS reward_mean, round(rs, 9) AS reward_std,
       round(greatest(rm - rs, 0.0), 9) AS reward_lo, round(least(rm + rs, 1.0), 9) AS reward_hi
FROM b"""))
def q_trajectory_bands(spark, sf):
    return ev.trajectory_bands(_ledger(spark, sf))


@register("token_loss_metrics", W(["token_loss"], """, per AS (
  SELECT batch, count(*) AS n_tokens, sum(CAST(mask AS INTEGER)) AS n_valid,
         sum(loss * CAST(mask AS INTEGER)) / (sum(CAST(mask AS INTEGER)) + 1e-8) AS masked_mean
  FROM token_loss GROUP BY batch)
SELECT batch, n_tokens, CAST(n_valid AS BIGINT) AS n_valid, round(masked_mean, 9) AS masked_mean,
       round((SELECT avg(masked_mean) FROM per), 9) AS val_mean
FROM per"""))
def q_token_loss_metrics(spark, sf):
    return ev.token_loss_metrics(V.token_loss(spark, sf))


def has_answer(solution, truth):
    """Reward for the form alone: there is an answer after ``####``."""
    return tx.extract_hash_answer(solution).isNotNull().cast("double")


REWARDS = {"exact": sc.score_exact_hash, "form": has_answer}
_CUT = "array_to_string(regexp_extract_all({0}, '\\S+\\s*')[{1}], '')"


@register("ratio_question_grid", W(["qa_rollouts"], f""", g AS (
  SELECT q.id, answer, {hash_extract('answer')} AS truth, sample_no, completion, ratio,
         CAST(floor(len(regexp_extract_all(answer, '\\S+\\s*')) * ratio) AS BIGINT) AS cut
  FROM qa_hash q JOIN qa_rollouts r ON r.id = q.id, (SELECT unnest([{', '.join(map(str, RATIOS))}]::DOUBLE[]) AS ratio)
  WHERE {hash_extract('answer')} IS NOT NULL),
s AS (SELECT *, CASE WHEN cut > 0 THEN {_CUT.format('answer', '1:cut')} || {_CUT.format('completion', 'cut + 1:')} ELSE completion END AS t FROM g),
v AS (SELECT *, CAST(CASE WHEN coalesce({hash_extract('t')}, {last_boxed('t')}) = truth THEN 1 ELSE 0 END AS BIGINT) AS exact,
             CAST(CASE WHEN {hash_extract('t')} IS NOT NULL THEN 1 ELSE 0 END AS BIGINT) AS form FROM s)
SELECT ratio, id, string_agg(CAST(exact AS VARCHAR), ',' ORDER BY sample_no) AS exact,
       string_agg(CAST(form AS VARCHAR), ',' ORDER BY sample_no) AS form, round(avg(exact), 9) AS mean_exact, round(avg(form), 9) AS mean_form
FROM v GROUP BY ratio, id"""))
def q_ratio_question_grid(spark, sf):
    """Every ratio x question x sample on whole texts: the revealed part of the
    answer with the sample's continuation, one array of scores per reward."""
    qa = V.qa_hash(spark, sf)
    problems = nz.norm_hash(qa)[0].select("id", "answer", F.col("reward_model.ground_truth").alias("ground_truth"))
    g = ev.ratio_grid(problems, V.qa_rollouts(spark, sf), "id", RATIOS, REWARDS)
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("bigint").cast("string")), ",")
    mean = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x) / F.size(c)
    return g.select("ratio", "id", text("exact").alias("exact"), text("form").alias("form"),
                    mean("exact").alias("mean_exact"), mean("form").alias("mean_form"))
