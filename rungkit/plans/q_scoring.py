"""Scoring queries over rollout views (ops 46-53)."""

from __future__ import annotations

from pyspark.sql import functions as F

from rungkit.functions import scoring as sc
from rungkit.functions import text as tx
from rungkit.operators import normalize as nz
from rungkit.operators.topk import top_k_per_group
from rungkit.plans.registry import register
from rungkit.plans.sqlutil import hash_extract, last_boxed, lit
from rungkit.sources import views as V
from rungkit.sources.generators import gen_parity

W = V.with_views
VEC_LEN = 16
PARITY_DS, CUMULATIVE_DS, R3_DS = ("xor/sequence_16_bitwidth_1", "xor/cumulative_sequence_16_bitwidth_1",
                                   "xor/r3_sequence_16_bitwidth_1")


def _parity_sql(sol="solution", truth="answer", cumulative=False):
    t, s = f"regexp_extract_all({truth}, '\\S+')", f"regexp_extract_all({sol}, '\\S+')"
    tv = lambda i: f"TRY_CAST({t}[{i}] AS BIGINT)"
    sv = lambda i: f"TRY_CAST({s}[{i}] AS BIGINT)"
    if cumulative:
        lt = f"xor(xor({tv('i')}, {tv('i + 1')}), CASE WHEN i = 1 THEN 0 ELSE {tv('i - 1')} END)"
        ls = f"xor(xor({sv('i')}, {sv('i + 1')}), CASE WHEN i = 1 THEN 0 ELSE {sv('i - 1')} END)"
    else:
        lt, ls = f"xor({tv('i')}, {tv('i + 1')})", f"xor({sv('i')}, {sv('i + 1')})"
    valid = (f"(len({s}[1:len({t})]) = len({t}) AND "
             f"list_bool_and(list_transform({s}[1:len({t})], lambda v: TRY_CAST(v AS BIGINT) IS NOT NULL)))")
    mism = f"coalesce(list_bool_or(list_transform(range(1, len({t}) + 1, 2), lambda i: {lt} <> {ls})), false)"
    return (f"CASE WHEN {sol} IS NULL THEN 0.0::DOUBLE WHEN NOT {valid} THEN 0.0::DOUBLE "
            f"ELSE 0.1::DOUBLE * CAST(len({s}) = len({t}) AS INTEGER) + 0.9::DOUBLE * CAST(NOT {mism} AS INTEGER) END")


def _tensor_sql(sol="solution", truth="ground_truth"):
    tr, pc = f"string_split({truth}, ' and ')", f"string_split({sol}, '####')[2:]"
    got = f"coalesce(TRY_CAST(regexp_extract({pc}[i], '^\\s*(\\d+)', 1) AS BIGINT), -1234)"
    want = f"TRY_CAST(trim({tr}[i]) AS BIGINT)"
    allm = f"coalesce(list_bool_and(list_transform(range(1, len({tr}) + 1), lambda i: coalesce({got} = {want}, false))), true)"
    return (f"CAST(CASE WHEN {sol} IS NULL THEN 0.0 WHEN len({pc}) < len({tr}) THEN 0.0 "
            f"WHEN len({pc}) > len({tr}) OR NOT {allm} THEN 0.1 ELSE 1.0 END AS DOUBLE)")


@register("score_parity", W(["parity_roll"], f"""
SELECT doc_id, {_parity_sql()} AS score FROM parity_roll"""))
def q_score_parity(spark, sf):
    d = V.parity_roll(spark, sf)
    return d.select("doc_id", sc.score_parity(F.col("solution"), F.col("answer")).alias("score"))


@register("score_cumulative_parity", W(["cparity_roll"], f"""
SELECT doc_id, {_parity_sql(cumulative=True)} AS score FROM cparity_roll"""))
def q_score_cumulative_parity(spark, sf):
    d = V.parity_roll(spark, sf, cumulative=True)
    return d.select("doc_id", sc.score_cumulative_parity(F.col("solution"), F.col("answer")).alias("score"))


@register("score_tensor", W(["tensor_roll"], f"""
SELECT doc_id, {_tensor_sql()} AS score FROM tensor_roll"""))
def q_score_tensor(spark, sf):
    d = V.tensor_roll(spark, sf)
    return d.select("doc_id", sc.score_tensor(F.col("solution"), F.col("ground_truth")).alias("score"))


def _rollouts(spark, sf):
    """Mixed rollouts: (data_source, rid, solution, ground_truth).  The truths
    and data sources are those the normalisers write; solutions are the parity
    and tensor variants, the dataset's own answers and the raw replies."""
    par, cum = V.parity_roll(spark, sf), V.parity_roll(spark, sf, True)

    def rolled(g, ds, r3=False):
        rows = nz.norm_parity(g.withColumn("split", F.lit("train")), key="doc_id", ds=ds, r3=r3)
        truth = rows.select("doc_id", "data_source", F.col("reward_model.ground_truth").alias("ground_truth"))
        return truth.join(g.select("doc_id", "solution"), "doc_id").select(
            "data_source", F.col("doc_id").alias("rid"), "solution", "ground_truth")

    t = V.tensor_roll(spark, sf).select(F.lit("tensor").alias("data_source"), F.col("doc_id").alias("rid"),
                                        "solution", "ground_truth")
    qa, boxed = V.qa_hash(spark, sf), V.qa_boxed(spark, sf)
    h = nz.norm_hash(qa)[0].select("data_source", F.col("id").alias("rid"), F.col("answer").alias("solution"),
                                   F.col("reward_model.ground_truth").alias("ground_truth"))
    b = nz.norm_boxed(boxed)[0].select("data_source", "id", F.col("reward_model.ground_truth").alias("ground_truth"))
    b = b.join(boxed.select("id", "solution", "plain_solution"), "id").select(
        "data_source", F.col("id").alias("rid"),
        F.when(F.col("id") % 3 == 0, F.col("plain_solution")).otherwise(F.col("solution")).alias("solution"), "ground_truth")
    out = rolled(par, PARITY_DS)
    for x in (rolled(cum, CUMULATIVE_DS), rolled(cum, R3_DS, True), t, h, b):
        out = out.unionByName(x)
    return out


def _scored(spark, sf):
    return sc.score_bound(sc.bound(_rollouts(spark, sf), sc.bindings_table(spark)))


_EXACT = f"coalesce({hash_extract('solution')}, {last_boxed('solution')})"
_TOKENS = "regexp_extract_all({0}, '\\S+')"
_SHORT = (f"len({_TOKENS.format('solution')}) < len({_TOKENS.format('ground_truth')}) OR list_bool_or(list_transform("
          f"{_TOKENS.format('solution')}[1:len({_TOKENS.format('ground_truth')})], lambda v: TRY_CAST(v AS BIGINT) IS NULL))")
_ROLL_SQL = f""", rollouts AS (
  SELECT {lit(PARITY_DS)} AS data_source, doc_id AS rid, solution, answer AS ground_truth FROM parity_roll
  UNION ALL SELECT {lit(CUMULATIVE_DS)}, doc_id, solution, answer FROM cparity_roll
  UNION ALL SELECT {lit(R3_DS)}, doc_id, solution, answer FROM cparity_roll
  UNION ALL SELECT 'tensor', doc_id, solution, ground_truth FROM tensor_roll
  UNION ALL SELECT {lit(nz.DS_GSM8K)}, id, answer, {hash_extract('answer')} FROM qa_hash WHERE {hash_extract('answer')} IS NOT NULL
  UNION ALL SELECT {lit(nz.DS_MATH)}, id, CASE WHEN id % 3 = 0 THEN plain_solution ELSE solution END, {last_boxed('solution')}
            FROM qa_boxed WHERE {last_boxed('solution')} IS NOT NULL),
scored AS (
  SELECT *, CASE data_source
      WHEN {lit(PARITY_DS)} THEN {_parity_sql(truth='ground_truth')}
      WHEN {lit(CUMULATIVE_DS)} THEN {_parity_sql(truth='ground_truth', cumulative=True)}
      WHEN {lit(R3_DS)} THEN {_parity_sql(truth='ground_truth', cumulative=True)}
      WHEN 'tensor' THEN {_tensor_sql()}
      ELSE CAST(CASE WHEN {_EXACT} = ground_truth THEN 1.0 ELSE 0.0 END AS DOUBLE) END AS score,
    CASE WHEN coalesce(CASE WHEN data_source LIKE 'xor/%' THEN {_SHORT}
                            WHEN data_source = 'tensor' THEN len(string_split(solution, '####')) - 1 < len(string_split(ground_truth, ' and '))
                            ELSE {_EXACT} IS NULL END, true) THEN 'unparsable' ELSE 'ok' END AS status
  FROM rollouts)"""
_ROLL_VIEWS = ["parity_roll", "cparity_roll", "tensor_roll", "qa_hash", "qa_boxed"]


@register("score_dispatch", W(_ROLL_VIEWS, _ROLL_SQL + """
SELECT data_source, rid, score, status FROM scored"""))
def q_score_dispatch(spark, sf):
    """Rollouts of normalised rows scored through the binding table."""
    return _scored(spark, sf).select("data_source", "rid", "score", "status")


@register("score_distribution", W(_ROLL_VIEWS, _ROLL_SQL + """
SELECT data_source, score, count(*) AS n, count(*) FILTER (WHERE status = 'unparsable') AS n_unparsable,
       count(*) FILTER (WHERE score IS NULL) AS n_malformed
FROM scored GROUP BY data_source, score"""))
def q_score_distribution(spark, sf):
    """Counts by data source and score, with the solutions that hold nothing
    to compare and the truths that could not be read."""
    return _scored(spark, sf).groupBy("data_source", "score").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("status") == "unparsable", 1)).alias("n_unparsable"),
        F.count(F.when(F.col("status") == "malformed", 1)).alias("n_malformed"))


@register("score_normalised", W(["qa_hash", "qa_boxed"], f""", par AS {V.sql_gen_parity(16, 1, 0, False)},
cum AS {V.sql_gen_parity(16, 1, 0, True)}
SELECT {lit(nz.DS_GSM8K)} AS data_source, 'exact' AS scorer, count(*) AS n, count(*) AS n_right FROM qa_hash WHERE {hash_extract('answer')} IS NOT NULL
UNION ALL SELECT {lit(nz.DS_MATH)}, 'exact', count(*), count(*) FROM qa_boxed WHERE {last_boxed('solution')} IS NOT NULL
UNION ALL SELECT {lit(PARITY_DS)}, 'parity', count(*), count(*) FROM par
UNION ALL SELECT {lit(R3_DS)}, 'cumulative_parity', count(*), count(*) FROM cum"""))
def q_score_normalised(spark, sf):
    """Every normaliser's rows, answered with their own answers: all score 1."""
    docs = V.table(spark, sf, "documents").select("doc_id")
    par, cum = (gen_parity(docs, "doc_id", 16, 1, 0, c).withColumn("split", F.lit("train")) for c in (False, True))
    rows = None
    for r in (nz.norm_hash(V.qa_hash(spark, sf))[0], nz.norm_boxed(V.qa_boxed(spark, sf))[0],
              nz.norm_parity(par, ds=PARITY_DS), nz.norm_parity(cum, ds=R3_DS, r3=True)):
        r = r.select("data_source", F.col("answer").alias("solution"), F.col("reward_model.ground_truth").alias("ground_truth"))
        rows = r if rows is None else rows.unionByName(r)
    s = sc.score_bound(sc.bound(rows, sc.bindings_table(spark)))
    return s.groupBy("data_source", "scorer").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("score") == 1.0, 1)).alias("n_right"))


def _split_partial(sol):
    toks = F.split(sol, " ", -1)
    part = F.concat(F.array_join(F.slice(toks, 1, 4), " "), F.lit(" "))
    resp = F.array_join(F.slice(toks, 5, F.size(toks)), " ")
    return part, resp


_SCORED_TEXT = "CASE WHEN partial_answer IS NOT NULL THEN partial_answer || response ELSE response END"


@register("score_with_partial", W(["parity_roll"], f""", pr AS (
  SELECT doc_id, answer,
         CASE WHEN doc_id % 3 = 0 OR len(string_split(solution, ' ')) <= 4 THEN NULL
              ELSE array_to_string(string_split(solution, ' ')[1:4], ' ') || ' ' END AS partial_answer,
         CASE WHEN doc_id % 3 = 0 OR len(string_split(solution, ' ')) <= 4 THEN solution
              ELSE array_to_string(string_split(solution, ' ')[5:], ' ') END AS response
  FROM parity_roll)
SELECT doc_id, CAST(partial_answer IS NOT NULL AS BIGINT) AS has_partial,
       {_parity_sql(sol=_SCORED_TEXT)} AS score
FROM pr"""))
def q_score_with_partial(spark, sf):
    """Rollouts whose prompt carried the first 4 solution tokens: the partial
    is prepended to the response before scoring."""
    d = V.parity_roll(spark, sf)
    part, resp = _split_partial(F.col("solution"))
    use = (F.col("doc_id") % 3 != 0) & (F.size(F.split("solution", " ", -1)) > 4)
    d = d.select("doc_id", "answer", F.when(use, part).alias("partial_answer"),
                 F.when(use, resp).otherwise(F.col("solution")).alias("response"))
    text = sc.with_partial(F.col("partial_answer"), F.col("response"))
    return d.select("doc_id", F.col("partial_answer").isNotNull().alias("has_partial"),
                    sc.score_parity(text, F.col("answer")).alias("score"))


@register("sparse_token_reward", W(["tensor_roll"], f""", s AS (
  SELECT doc_id, {_tensor_sql()} AS r, least(len(regexp_extract_all(solution, '\\S+')), {VEC_LEN}) AS n_valid
  FROM tensor_roll)
SELECT doc_id, n_valid, CASE WHEN n_valid > 0 THEN n_valid - 1 END AS reward_pos,
       CAST(CASE WHEN n_valid > 0 THEN r ELSE 0.0 END AS DOUBLE) AS vec_sum, CAST(n_valid = 0 AS BIGINT) AS no_valid_token
FROM s"""))
def q_sparse_token_reward(spark, sf):
    """Per-token reward vectors (length 16) with the score on the last valid token."""
    d = V.tensor_roll(spark, sf)
    d = d.select("doc_id", sc.score_tensor(F.col("solution"), F.col("ground_truth")).alias("r"),
                 F.least(tx.word_count("solution"), F.lit(VEC_LEN)).alias("n_valid"))
    v = d.withColumn("vec", sc.sparse_token_reward(F.col("r"), F.col("n_valid"), VEC_LEN))
    return v.select("doc_id", "n_valid",
                    F.when(F.col("n_valid") > 0, F.col("n_valid") - 1).alias("reward_pos"),
                    F.aggregate("vec", F.lit(0.0), lambda a, x: a + x).alias("vec_sum"),
                    (F.col("n_valid") == 0).alias("no_valid_token"))


@register("score_metrics_flatten", W(["tensor_roll"], f"""
SELECT doc_id, metric, value FROM (
  SELECT doc_id, {_tensor_sql()} AS score,
         CAST(len(string_split(solution, '####')[2:]) AS DOUBLE) AS n_pieces,
         CAST(len(string_split(ground_truth, ' and ')) AS DOUBLE) AS n_truths
  FROM tensor_roll)
UNPIVOT INCLUDE NULLS (value FOR metric IN (score, n_pieces, n_truths))"""))
def q_score_metrics_flatten(spark, sf):
    """Dict-valued scores to long (id, metric, value) form; ``score`` is the reward."""
    d = V.tensor_roll(spark, sf).withColumn("data_source", F.lit("tensor"))
    s = sc.score_bound(sc.bound(d, sc.bindings_table(spark)))
    return sc.metrics_flatten(s, "doc_id")


@register("examine_samples", W(_ROLL_VIEWS, _ROLL_SQL + """
SELECT data_source, rid, score FROM (
  SELECT *, row_number() OVER (PARTITION BY data_source ORDER BY rid) AS rn FROM scored) WHERE rn <= 1"""))
def q_examine_samples(spark, sf):
    """First ``num_examine`` (=1) scored rows per data source."""
    r = top_k_per_group(_rollouts(spark, sf), "data_source", "rid", 1)      # scored after the pick
    return sc.score_bound(sc.bound(r, sc.bindings_table(spark))).select("data_source", "rid", "score")
