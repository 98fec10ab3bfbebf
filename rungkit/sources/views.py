"""Shaped inputs derived from the driver tables (FIXTURES.md part B).

Each view exists twice: a Spark builder used by ``queries()`` and a
DuckDB SQL definition used by the oracle. Derived values use the
md5-based hash contract of :mod:`rungkit.functions.hashing`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rungkit.functions.hashing import h32, hash_key, sql_h32
from rungkit.sources.tables import table

EPOCH = "2024-01-01"
TURNS = 1_000_000_007           # more than a conversation has turns, so that ids of pairs do not meet


# --------------------------------------------------------------- attempts

def attempts(spark: SparkSession, sf: str) -> DataFrame:
    """events -> curriculum attempts (sample_id, step, pos, portion, reward, split, ts)."""
    ev = table(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    return ev.select(
        F.col("user_id").alias("sample_id"),
        F.datediff(F.to_date("ts"), F.lit(EPOCH)).cast("int").alias("step"),
        F.col("event_id").alias("pos"),
        (F.floor(k / F.lit(25)) / F.lit(10.0)).cast("double").alias("portion"),
        F.when(F.col("value") > 25, 1.0).otherwise(0.0).alias("reward"),
        F.when(F.col("event_type") == "signup", "test").otherwise("train").alias("split"),
        F.col("ts"),
    )


def attempts_train(spark: SparkSession, sf: str) -> DataFrame:
    return attempts(spark, sf).filter(F.col("split") == "train")


SQL = {}
SQL["attempts"] = f"""
attempts AS (
  SELECT user_id AS sample_id,
         CAST(date_diff('day', DATE '{EPOCH}', CAST(ts AS DATE)) AS BIGINT) AS step,
         event_id AS pos,
         floor(CAST(json_extract_string(props, '$.k') AS INTEGER) / 25) / 10.0 AS portion,
         CAST(CASE WHEN value > 25 THEN 1.0 ELSE 0.0 END AS DOUBLE) AS reward,
         CASE WHEN event_type = 'signup' THEN 'test' ELSE 'train' END AS split,
         ts
  FROM events)"""
SQL["attempts_train"] = """
attempts_train AS (SELECT * FROM attempts WHERE split = 'train')"""
DEPS = {"attempts_train": ["attempts"]}


def with_views(names, body: str) -> str:
    """Prefix ``body`` with the CTEs for ``names`` (and their dependencies)."""
    order: list[str] = []

    def visit(n):
        for d in DEPS.get(n, []):
            visit(d)
        if n not in order:
            order.append(n)

    for n in names:
        visit(n)
    return "WITH " + ",\n".join(SQL[n].strip() for n in order) + "\n" + body


# ------------------------------------------------------------ QA views

def _qa_pairs(spark, sf):
    conv = table(spark, sf, "conversations")
    u = conv.filter(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("question"))
    a = conv.filter(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("reply"))
    j = u.join(a, ["conv_id", "turn"])
    j = j.withColumn("id", F.col("conv_id") * TURNS + F.col("turn"))
    j = j.withColumn("hh", h32(F.col("id")))
    return j.withColumn("split", F.when(F.col("conv_id") % 5 == 0, "test").otherwise("train"))


def qa_hash(spark: SparkSession, sf: str) -> DataFrame:
    """GSM8K-shaped rows: question, answer ending in ``#### <number>``."""
    j = _qa_pairs(spark, sf)
    n = F.col("hh") % 100000
    body = F.when((F.col("hh") % 5 == 0) & (n >= 1000),
                  F.concat(F.floor(n / 1000).cast("bigint").cast("string"), F.lit(","),
                           F.lpad((n % 1000).cast("string"), 3, "0"))).otherwise(n.cast("string"))
    num = F.concat(F.when(F.col("hh") % 7 == 0, "-").otherwise(""), body)
    answer = F.when(F.col("hh") % 11 == 0, F.concat(F.col("reply"), F.lit("\n"), num)) \
              .otherwise(F.concat(F.col("reply"), F.lit("\n#### "), num))
    return j.select("id", "question", answer.alias("answer"), "split")


def qa_rollouts(spark: SparkSession, sf: str) -> DataFrame:
    """Two to six completions per qa_hash row by ``(id + sample) % 4``: its
    answer, the answer with a digit more, the question, a sentence around the
    answer."""
    q = qa_hash(spark, sf)
    d = q.select("id", "question", "answer", "split",
                 F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("id") % 5 + 1)).alias("sample_no"))
    r = (F.col("id") + F.col("sample_no")) % 4
    text = F.when(r == 0, F.col("answer")).when(r == 1, F.concat("answer", F.lit("7"))).when(r == 2, F.col("question")) \
            .otherwise(F.concat(F.lit("I think: "), F.col("answer"), F.lit(" done")))
    return d.select("id", "sample_no", text.alias("completion"))


def qa_boxed(spark: SparkSession, sf: str) -> DataFrame:
    r"""MATH-shaped rows: problem, solution with 0, 1 or 2 ``\boxed{}`` blocks."""
    j = _qa_pairs(spark, sf)
    n = F.col("hh") % 1000
    k = F.col("hh") % 4
    ns = n.cast("string")
    tailx = F.when(k == 0, F.concat(F.lit(" \\boxed{"), ns, F.lit("}"))) \
             .when(k == 1, F.concat(F.lit(" \\boxed{\\frac{"), (n % 9 + 1).cast("string"), F.lit("}{2}}"))) \
             .when(k == 2, F.concat(F.lit(" \\boxed{"), ns, F.lit("} and \\boxed{"), (n + 1).cast("string"), F.lit("}"))) \
             .otherwise(F.lit(""))
    return j.select("id", F.col("question").alias("problem"), F.concat("reply", tailx).alias("solution"),
                    F.col("reply").alias("plain_solution"), ns.alias("short_answer"), "split")


def multi_gen(spark: SparkSession, sf: str) -> DataFrame:
    """OpenR1-shaped rows: several generations with per-generation flags."""
    d = table(spark, sf, "documents").alias("d")
    lab = table(spark, sf, "labels").select("doc_id", "quality")
    j = d.join(lab, "doc_id", "left")
    hh = h32(F.col("doc_id"))
    gens = F.split(F.col("text"), "\n", -1)
    flags = F.transform(gens, lambda g, i: (hash_key(F.col("doc_id"), i) % 2) == F.col("quality"))
    flags = F.when(F.col("quality").isNull(), F.lit(None).cast("array<boolean>")) \
             .when(hh % 4 == 0, F.slice(flags, 1, F.greatest(F.size(gens) - 1, F.lit(0)))).otherwise(flags)
    solution = F.when(F.col("doc_id") % 3 == 0, F.lit("   ")).otherwise(F.col("text"))
    m4 = F.col("doc_id") % 4
    answer = F.when(m4 == 0, (F.col("n_chars") % 1000).cast("string")) \
              .when(m4 == 1, F.concat(F.lit("x"), F.col("lang"))) \
              .when(m4 == 2, F.lit("")) \
              .otherwise(F.concat(F.lit(" "), (F.col("doc_id") % 97).cast("string"), F.lit(" ")))
    return j.select("doc_id",
                    F.concat(F.lit("  Problem "), F.col("doc_id").cast("string"), F.lit(" ("), F.col("lang"),
                             F.lit(")  ")).alias("problem"),
                    solution.alias("solution"), answer.alias("answer"),
                    F.col("source").alias("problem_type"), F.col("lang").alias("question_type"),
                    F.col("source").alias("source"),
                    gens.alias("generations"), flags.alias("correctness_math_verify"))


def cot(spark: SparkSession, sf: str) -> DataFrame:
    """Reasoning texts: documents as answers."""
    return table(spark, sf, "documents").select("doc_id", F.col("text").alias("answer"), "source", "lang")


def prompts(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.array(F.struct(F.lit("user").alias("role"),
                                               F.col("text").alias("content"))).alias("prompt"))


def chats(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations gathered into ordered message arrays (one per conv)."""
    c = table(spark, sf, "conversations")
    g = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("m"))
    return g.select("conv_id", F.transform("m", lambda x: F.struct(x["role"].alias("role"),
                                                                    x["text"].alias("content"))).alias("prompt"))


SQL["qa_pairs"] = f"""
qa_pairs AS (
  SELECT u.conv_id, u.turn, u.text AS question, a.text AS reply, u.conv_id * {TURNS} + u.turn AS id,
         {sql_h32(f'u.conv_id * {TURNS} + u.turn')} AS hh,
         CASE WHEN u.conv_id % 5 = 0 THEN 'test' ELSE 'train' END AS split
  FROM conversations u JOIN conversations a
    ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
  WHERE u.role = 'user')"""
SQL["qa_hash"] = """
qa_hash AS (
  SELECT id, question,
         reply || CASE WHEN hh % 11 = 0 THEN chr(10) ELSE chr(10) || '#### ' END
               || CASE WHEN hh % 7 = 0 THEN '-' ELSE '' END
               || CASE WHEN hh % 5 = 0 AND hh % 100000 >= 1000
                       THEN CAST((hh % 100000) // 1000 AS VARCHAR) || ',' || lpad(CAST(hh % 1000 AS VARCHAR), 3, '0')
                       ELSE CAST(hh % 100000 AS VARCHAR) END AS answer,
         split
  FROM qa_pairs)"""
SQL["qa_rollouts"] = """
qa_rollouts AS (
  SELECT id, sample_no, CASE (id + sample_no) % 4 WHEN 0 THEN answer WHEN 1 THEN answer || '7' WHEN 2 THEN question
                        ELSE 'I think: ' || answer || ' done' END AS completion
  FROM (SELECT *, unnest(range(0, id % 5 + 2)) AS sample_no FROM qa_hash))"""
SQL["qa_boxed"] = """
qa_boxed AS (
  SELECT id, question AS problem,
         reply || CASE hh % 4
                    WHEN 0 THEN ' \\boxed{' || CAST(hh % 1000 AS VARCHAR) || '}'
                    WHEN 1 THEN ' \\boxed{\\frac{' || CAST(hh % 1000 % 9 + 1 AS VARCHAR) || '}{2}}'
                    WHEN 2 THEN ' \\boxed{' || CAST(hh % 1000 AS VARCHAR) || '} and \\boxed{'
                                || CAST(hh % 1000 + 1 AS VARCHAR) || '}'
                    ELSE '' END AS solution,
         reply AS plain_solution, CAST(hh % 1000 AS VARCHAR) AS short_answer, split
  FROM qa_pairs)"""
SQL["multi_gen"] = f"""
multi_gen AS (
  SELECT d.doc_id, '  Problem ' || CAST(d.doc_id AS VARCHAR) || ' (' || d.lang || ')  ' AS problem,
         CASE WHEN d.doc_id % 3 = 0 THEN '   ' ELSE d.text END AS solution,
         CASE d.doc_id % 4 WHEN 0 THEN CAST(d.n_chars % 1000 AS VARCHAR) WHEN 1 THEN 'x' || d.lang
                           WHEN 2 THEN '' ELSE ' ' || CAST(d.doc_id % 97 AS VARCHAR) || ' ' END AS answer,
         d.source AS problem_type, d.lang AS question_type, d.source AS source,
         string_split(d.text, chr(10)) AS generations,
         CASE WHEN l.quality IS NULL THEN NULL
              ELSE list_transform(
                     CASE WHEN {sql_h32('d.doc_id')} % 4 = 0
                          THEN string_split(d.text, chr(10))[1:greatest(len(string_split(d.text, chr(10))) - 1, 0)]
                          ELSE string_split(d.text, chr(10)) END,
                     lambda g, i: ({sql_h32("CAST(d.doc_id AS VARCHAR) || ':' || CAST(i - 1 AS VARCHAR)")} % 2) = l.quality)
         END AS correctness_math_verify
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"""
SQL["cot"] = """
cot AS (SELECT doc_id, text AS answer, source, lang FROM documents)"""
SQL["chats"] = """
chats AS (
  SELECT conv_id, list({'role': role, 'content': text} ORDER BY turn) AS prompt
  FROM conversations GROUP BY conv_id)"""
DEPS.update({"qa_rollouts": ["qa_hash"], "qa_hash": ["qa_pairs"], "qa_boxed": ["qa_pairs"]})


# ------------------------------------------------------------ rollout views

def parity_roll(spark: SparkSession, sf: str, cumulative: bool = False) -> DataFrame:
    """Parity truths from documents.doc_id plus one solution per ``doc_id % 8`` rule:
    exact, pair flip (y and z), z flip, truncated, extra token, word token, empty, NULL."""
    from rungkit.sources.generators import gen_parity
    ids = table(spark, sf, "documents").select("doc_id")
    g = gen_parity(ids, "doc_id", 8, 1, 0, cumulative)
    return g.withColumn("solution", parity_solution(F.col("answer"), F.col("doc_id") % 8))


def parity_solution(truth, rule):
    t = F.split(truth, " ")
    flip = lambda v: (F.lit(1) - v.cast("int")).cast("string")
    n = F.size(t)
    return F.when(rule == 0, truth) \
        .when(rule == 1, F.array_join(F.concat(F.array(flip(t[0]), flip(t[1])), F.slice(t, 3, n)), " ")) \
        .when(rule == 2, F.array_join(F.concat(F.array(t[0], flip(t[1])), F.slice(t, 3, n)), " ")) \
        .when(rule == 3, F.array_join(F.slice(t, 1, n - 1), " ")) \
        .when(rule == 4, F.concat(truth, F.lit(" 1"))) \
        .when(rule == 5, F.array_join(F.concat(F.slice(t, 1, 3), F.array(F.lit("abc")), F.slice(t, 5, n)), " ")) \
        .when(rule == 6, F.lit(""))


def tensor_roll(spark: SparkSession, sf: str) -> DataFrame:
    """Two-part truths 'a and b' with one solution per ``doc_id % 7`` rule:
    exact, swapped, one piece, extra piece, negative, comma, no marker."""
    d = table(spark, sf, "documents").select("doc_id").withColumn("hh", h32(F.col("doc_id")))
    a = (F.col("hh") % 100).cast("string")
    b = (F.floor(F.col("hh") / 100) % 100).cast("string")
    r = F.col("doc_id") % 7
    sol = F.when(r == 0, F.concat(F.lit("so #### "), a, F.lit(" then #### "), b)) \
        .when(r == 1, F.concat(F.lit("#### "), b, F.lit(" #### "), a)) \
        .when(r == 2, F.concat(F.lit("#### "), a)) \
        .when(r == 3, F.concat(F.lit("#### "), a, F.lit(" #### "), b, F.lit(" #### 7"))) \
        .when(r == 4, F.concat(F.lit("#### -"), a, F.lit(" #### "), b)) \
        .when(r == 5, F.concat(F.lit("#### 1,"), F.lpad(a, 3, "0"), F.lit(" #### "), b)) \
        .otherwise(F.concat(a, F.lit(" and "), b))
    return d.select("doc_id", F.concat(a, F.lit(" and "), b).alias("ground_truth"), sol.alias("solution"))


def _sql_vals(tag):
    return (f"list_transform(range(0, 8), lambda i: CAST(({sql_h32_expr_tag(tag)}) % 2 AS INTEGER))")


def sql_h32_expr_tag(tag):
    return sql_h32(f"'0:' || CAST(doc_id AS VARCHAR) || ':{tag}:' || CAST(i AS VARCHAR)")


def _sql_parity(cumulative: bool) -> str:
    z = ("list_transform(range(1, 9), lambda k: list_reduce(list_transform(range(1, k + 1), "
         "lambda q: xor(x[q], y[q])), lambda a, b: xor(a, b)))") if cumulative else \
        "list_transform(range(1, 9), lambda k: xor(x[k], y[k]))"
    flip = lambda e: f"CAST(1 - CAST({e} AS INTEGER) AS VARCHAR)"
    return f"""(
  SELECT doc_id, x_text, answer,
    CASE doc_id % 8
      WHEN 0 THEN answer
      WHEN 1 THEN array_to_string([{flip('t[1]')}, {flip('t[2]')}] || t[3:], ' ')
      WHEN 2 THEN array_to_string([t[1], {flip('t[2]')}] || t[3:], ' ')
      WHEN 3 THEN array_to_string(t[1:len(t) - 1], ' ')
      WHEN 4 THEN answer || ' 1'
      WHEN 5 THEN array_to_string(t[1:3] || ['abc'] || t[5:], ' ')
      WHEN 6 THEN ''
      ELSE NULL END AS solution
  FROM (SELECT *, string_split(answer, ' ') AS t FROM (
    SELECT doc_id, array_to_string(list_transform(x, lambda v: CAST(v AS VARCHAR)), ' ') AS x_text,
           array_to_string(flatten(list_transform(range(1, 9), lambda k: [CAST(y[k] AS VARCHAR),
                                                                    CAST(z[k] AS VARCHAR)])), ' ') AS answer
    FROM (SELECT doc_id, x, y, {z} AS z FROM (
      SELECT doc_id, {_sql_vals('x')} AS x, {_sql_vals('y')} AS y FROM documents)))))"""


SQL["parity_roll"] = "parity_roll AS " + _sql_parity(False)
SQL["cparity_roll"] = "cparity_roll AS " + _sql_parity(True)
SQL["tensor_roll"] = f"""
tensor_roll AS (
  SELECT doc_id, a || ' and ' || b AS ground_truth,
    CASE doc_id % 7
      WHEN 0 THEN 'so #### ' || a || ' then #### ' || b
      WHEN 1 THEN '#### ' || b || ' #### ' || a
      WHEN 2 THEN '#### ' || a
      WHEN 3 THEN '#### ' || a || ' #### ' || b || ' #### 7'
      WHEN 4 THEN '#### -' || a || ' #### ' || b
      WHEN 5 THEN '#### 1,' || lpad(a, 3, '0') || ' #### ' || b
      ELSE a || ' and ' || b END AS solution
  FROM (SELECT doc_id, CAST(hh % 100 AS VARCHAR) AS a, CAST((hh // 100) % 100 AS VARCHAR) AS b
        FROM (SELECT doc_id, {sql_h32('doc_id')} AS hh FROM documents)))"""


# ------------------------------------------------------------ evaluation views

def rollouts(spark: SparkSession, sf: str) -> DataFrame:
    """lineitem as scored generations: problem = order, reward by return flag."""
    li = table(spark, sf, "lineitem")
    reward = F.when(F.col("l_returnflag") == "R", 1.0).when(F.col("l_returnflag") == "A", 0.1).otherwise(0.0)
    return li.select(F.col("l_orderkey").alias("problem_id"), F.col("l_linenumber").alias("sample_no"),
                     reward.alias("reward"))


def labelled_rollouts(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("problem_id"),
                                          F.col("o_orderpriority").alias("label"))
    return rollouts(spark, sf).join(o, "problem_id")


def token_loss(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    return li.select((F.col("l_orderkey") % 64).alias("batch"), F.abs("l_discount").alias("loss"),
                     (F.col("l_tax") > 0.04).alias("mask"))


SQL["rollouts"] = """
rollouts AS (
  SELECT l_orderkey AS problem_id, CAST(l_linenumber AS BIGINT) AS sample_no,
         CAST(CASE l_returnflag WHEN 'R' THEN 1.0 WHEN 'A' THEN 0.1 ELSE 0.0 END AS DOUBLE) AS reward
  FROM lineitem)"""
SQL["labelled_rollouts"] = """
labelled_rollouts AS (
  SELECT r.*, o.o_orderpriority AS label FROM rollouts r JOIN orders o ON o.o_orderkey = r.problem_id)"""
SQL["token_loss"] = """
token_loss AS (SELECT l_orderkey % 64 AS batch, abs(l_discount) AS loss, l_tax > 0.04 AS mask FROM lineitem)"""
DEPS["labelled_rollouts"] = ["rollouts"]


def sql_gen_parity(length: int, bit_width: int, seed, cumulative: bool) -> str:
    """DuckDB twin of :func:`rungkit.sources.generators.gen_parity` over documents.doc_id."""
    m = 1 << bit_width

    def vals(tag):
        return (f"list_transform(range(0, {length}), lambda i: CAST(({sql_h32(chr(39) + str(seed) + ':' + chr(39) + ' || CAST(doc_id AS VARCHAR) || ' + chr(39) + ':' + tag + ':' + chr(39) + ' || CAST(i AS VARCHAR)')}) % {m} AS INTEGER))")
    z = (f"list_transform(range(1, {length} + 1), lambda k: list_reduce(list_transform(range(1, k + 1), "
         f"lambda q: xor(x[q], y[q])), lambda a, b: xor(a, b)))") if cumulative else \
        f"list_transform(range(1, {length} + 1), lambda k: xor(x[k], y[k]))"
    return f"""(
  SELECT doc_id, array_to_string(list_transform(x, lambda v: CAST(v AS VARCHAR)), ' ') AS x_text,
         array_to_string(flatten(list_transform(range(1, {length} + 1),
           lambda k: [CAST(y[k] AS VARCHAR), CAST(z[k] AS VARCHAR)])), ' ') AS answer
  FROM (SELECT doc_id, x, y, {z} AS z FROM (SELECT doc_id, {vals('x')} AS x, {vals('y')} AS y FROM documents)))"""
