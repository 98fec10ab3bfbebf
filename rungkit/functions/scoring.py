"""Rule-based rollout scorers as Column expressions (ops 46-52).

Each scorer maps (solution, ground_truth) columns to a double score. A
malformed ground truth gives NULL (counted as malformed by the scoring
job) instead of aborting the job.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rungkit.functions import text as tx

# ---- fixed values of the source rules
LENGTH_CREDIT = 0.1
PARITY_CREDIT = 0.9
TENSOR_MISS = -1234
TENSOR_PARTIAL = 0.1


def _ints(tokens: Column) -> Column:
    return F.transform(tokens, lambda t: t.try_cast("bigint"))


def _truth_ok(t: Column, ti: Column) -> Column:
    return (F.size(t) % 2 == 0) & F.forall(ti, lambda v: v.isNotNull())


def _pair_values(vals: Column, cumulative: bool) -> Column:
    """Per pair: y ^ z (or y ^ z ^ previous z). Arrays are HOF arguments,
    never captured by a lambda, so each is evaluated once per row."""
    ys = F.filter(vals, lambda v, i: i % 2 == 0)
    zs = F.filter(vals, lambda v, i: i % 2 == 1)
    x = F.zip_with(ys, zs, lambda a, b: a.bitwiseXOR(b))
    if cumulative:
        prev = F.concat(F.array(F.lit(0).cast("bigint")), F.slice(zs, 1, F.greatest(F.size(zs) - 1, F.lit(0))))
        x = F.zip_with(x, prev, lambda a, b: a.bitwiseXOR(b))
    return x


def _once(value: Column, fn: Callable[[Column], Column]) -> Column:
    """``fn(value)`` with the value worked out once a row, however often ``fn`` reads it."""
    return F.element_at(F.transform(F.array(value), fn), 1)


def _parity_core(solution: Column, truth: Column, cumulative: bool) -> Column:
    def scored(x: Column) -> Column:
        n, si, ti = F.size(x["t"]), x["si"], x["ti"]
        # every token of the first L must be present and integer, else 0
        valid = (F.size(si) == n) & F.forall(si, lambda v: v.isNotNull())
        mismatch = F.exists(F.zip_with(_pair_values(ti, cumulative), _pair_values(si, cumulative),
                                       lambda a, b: a != b), lambda m: F.coalesce(m, F.lit(True)))
        score = F.lit(LENGTH_CREDIT) * (n == F.size(x["s"])).cast("double") + \
            F.lit(PARITY_CREDIT) * (~mismatch).cast("double")
        return F.when(~_truth_ok(x["t"], ti), F.lit(None).cast("double")) \
                .when(solution.isNull(), F.lit(0.0)) \
                .when(~valid, F.lit(0.0)).otherwise(score)

    words = F.struct(tx.words(truth).alias("t"), tx.words(solution).alias("s"))
    return _once(words, lambda w: _once(F.struct(
        w["t"].alias("t"), w["s"].alias("s"), _ints(w["t"]).alias("ti"),
        _ints(F.slice(w["s"], F.lit(1), F.size(w["t"]))).alias("si")), scored))


def score_parity(solution: Column, truth: Column) -> Column:
    """0.1 * (same token count) + 0.9 * (every pair's y^z equals the truth's)."""
    return _parity_core(solution, truth, False)


def score_cumulative_parity(solution: Column, truth: Column) -> Column:
    """As :func:`score_parity` on y_i ^ z_i ^ z_{i-1} (z_{-1} = 0)."""
    return _parity_core(solution, truth, True)


def score_tensor(solution: Column, truth: Column) -> Column:
    """Pieces after each '####' vs ' and '-separated integer truths:
    fewer pieces 0; any mismatch, bad truth or extra piece 0.1; else 1."""
    truths = F.split(truth, " and ", -1)
    parts = F.split(solution, "####", -1)
    pieces = F.slice(parts, 2, F.size(parts))
    nt, np_ = F.size(truths), F.size(pieces)
    got = F.transform(pieces, lambda p: F.coalesce(
        F.regexp_extract(p, r"^(?U)\s*(\d+)", 1).try_cast("bigint"), F.lit(TENSOR_MISS).cast("bigint")))
    want = F.transform(truths, lambda t: tx.py_strip(t).try_cast("bigint"))
    all_match = F.forall(F.zip_with(got, want, lambda a, b: F.coalesce(a == b, F.lit(False))), lambda x: x)
    return F.when(truth.isNull(), F.lit(None).cast("double")) \
            .when(solution.isNull(), F.lit(0.0)) \
            .when(np_ < nt, F.lit(0.0)) \
            .when((np_ == nt) & all_match, F.lit(1.0)).otherwise(F.lit(TENSOR_PARTIAL))


def score_exact_hash(solution: Column, truth: Column) -> Column:
    """Default scorer: the answer after '####' equals the truth exactly; a
    solution without such an answer is judged by its last boxed expression."""
    got = F.coalesce(tx.extract_hash_answer(solution), tx.last_boxed(solution))
    return F.when(truth.isNull(), F.lit(None).cast("double")) \
            .when(F.coalesce(got == truth, F.lit(False)), F.lit(1.0)).otherwise(F.lit(0.0))


def _no_pairs(solution: Column, truth: Column) -> Column:
    """Parity texts: too few tokens, or some that are no integers."""
    n = F.size(tx.words(truth))
    return _once(F.struct(n.alias("n"), _ints(F.slice(tx.words(solution), F.lit(1), n)).alias("si")),
                 lambda x: (F.size(x["si"]) < x["n"]) | F.exists(x["si"], lambda v: v.isNull()))


def _no_answer(solution: Column, truth: Column) -> Column:
    return F.coalesce(tx.extract_hash_answer(solution), tx.last_boxed(solution)).isNull()


def _few_pieces(solution: Column, truth: Column) -> Column:
    return F.size(F.split(solution, "####", -1)) - 1 < F.size(F.split(truth, " and ", -1))


def tensor_metrics(solution: Column, truth: Column) -> Column:
    """A map-valued scorer: the reward under ``score`` and what it is made of."""
    return F.create_map(F.lit("score"), score_tensor(solution, truth),
                        F.lit("n_pieces"), (F.size(F.split(solution, "####", -1)) - 1).cast("double"),
                        F.lit("n_truths"), F.size(F.split(truth, " and ", -1)).cast("double"))


@dataclass(frozen=True)
class Scorer:
    """``fn(solution, truth)`` gives a double or a map of doubles with the
    reward under ``score``; ``unparsable(solution, truth)`` says that the
    solution holds nothing to compare."""
    fn: Callable[[Column, Column], Column]
    unparsable: Callable[[Column, Column], Column] = _no_answer
    metrics: bool = False


SCORERS: dict[str, Scorer] = {}
#: data source, or the beginning of one, to the scorer it is bound to
BINDINGS: dict[str, str] = {}
DEFAULT_SCORER = "exact"


def register_scorer(name: str, fn: Callable[[Column, Column], Column], unparsable=_no_answer, metrics: bool = False,
                    sources=None) -> None:
    """Register a scorer (Column builder or a pandas UDF wrapped to take two
    Columns) and bind it to ``sources`` (its own name by default)."""
    SCORERS[name] = Scorer(fn, unparsable, metrics)
    for source in (name,) if sources is None else sources:
        BINDINGS[source] = name


register_scorer("exact", score_exact_hash, sources=())
register_scorer("parity", score_parity, _no_pairs, sources=("xor/sequence",))
register_scorer("cumulative_parity", score_cumulative_parity, _no_pairs, sources=("xor/cumulative_sequence", "xor/r3_sequence"))
register_scorer("tensor", tensor_metrics, _few_pieces, metrics=True)


def bindings_table(spark, bindings: dict[str, str] | None = None):
    """The binding table: ``source``, ``scorer``.  A job may join its own."""
    rows = list((BINDINGS if bindings is None else bindings).items())
    return spark.createDataFrame(rows, "source string, scorer string")


def bound(df: DataFrame, bindings: DataFrame, data_source: str = "data_source") -> DataFrame:
    """``df`` with ``scorer``: that of the longest source in the binding table
    which the row's data source equals or continues with ``_``, else the
    default.  The table (a row for each kind of data source) goes to the rows
    as one map, in which the beginnings of the data source, cut at its
    underscores, are looked up: rows are read once and stay where they are,
    however few data sources they share."""
    entries = F.collect_list(F.struct("source", "scorer"))
    names = (bindings.where("source is not null").groupBy("source").agg(F.max("scorer").alias("scorer"))
             .agg(F.map_from_entries(entries).alias("_bindings")))
    parts = F.split(F.col(data_source), "_", -1)
    cuts = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "_"))
    longest = F.try_element_at(F.filter(cuts, lambda c: F.map_contains_key("_bindings", c)), F.lit(-1))
    return (df.crossJoin(F.broadcast(names))
            .withColumn("scorer", F.coalesce(F.try_element_at("_bindings", longest), F.lit(DEFAULT_SCORER))).drop("_bindings"))


def score_bound(df: DataFrame, solution: str = "solution", truth: str = "ground_truth") -> DataFrame:
    """Rows of :func:`bound` with ``metrics`` (map), ``score`` and ``status``:
    ``ok``, ``malformed`` (no score can be given to the truth) or ``unparsable``
    (the solution holds nothing to compare; it keeps its score).  A scorer
    that is not registered fails the job."""
    sol, tr = F.col(solution), F.col(truth)
    metrics = unparsable = None
    for name, s in SCORERS.items():
        here = F.col("scorer") == F.lit(name)
        value = s.fn(sol, tr) if s.metrics else F.create_map(F.lit("score"), s.fn(sol, tr))
        empty = F.coalesce(s.unparsable(sol, tr), F.lit(True))
        metrics = F.when(here, value) if metrics is None else metrics.when(here, value)
        unparsable = F.when(here, empty) if unparsable is None else unparsable.when(here, empty)
    unknown = F.raise_error(F.concat(F.lit("no scorer named "), F.col("scorer")))
    d = df.withColumns({"metrics": metrics.otherwise(unknown.cast("map<string,double>")), "_empty": unparsable})
    d = d.withColumn("score", F.col("metrics")["score"])
    return d.withColumn("status", F.when(F.col("score").isNull(), "malformed").when(F.col("_empty"), "unparsable").otherwise("ok")).drop("_empty")


def metrics_flatten(df: DataFrame, *keys: str, metrics: str = "metrics") -> DataFrame:
    """Map-valued scores in long form: keys, ``metric``, ``value``."""
    return df.select(*keys, F.explode(metrics).alias("metric", "value"))


def score_dispatch(data_source: Column, solution: Column, truth: Column, default=score_exact_hash) -> Column:
    """The score alone, as one expression: each row by the scorer bound to its
    data source or to the family it belongs to (``xor/sequence`` also scores
    what a normaliser labels ``xor/sequence_16_bitwidth_1``); one CASE over the
    bindings, longest first, evaluated JVM-side."""
    expr = None
    for source in sorted((b for b in BINDINGS if BINDINGS[b] in SCORERS), key=len, reverse=True):
        s = SCORERS[BINDINGS[source]]
        cond = (data_source == F.lit(source)) | F.startswith(data_source, F.lit(f"{source}_"))
        value = s.fn(solution, truth)["score"] if s.metrics else s.fn(solution, truth)
        expr = F.when(cond, value) if expr is None else expr.when(cond, value)
    fallback = default(solution, truth)
    return fallback if expr is None else expr.otherwise(fallback)


def with_partial(partial: Column, response: Column) -> Column:
    """Scored text = partial answer + response when a partial exists."""
    return F.when(partial.isNotNull(), F.concat(partial, response)).otherwise(response)


def sparse_token_reward(reward: Column, n_valid: Column, length: int) -> Column:
    """Zero vector with the reward at the last valid response position (all
    zeros when there is no valid token)."""
    return F.transform(F.sequence(F.lit(0), F.lit(length - 1)),
                       lambda i: F.when((n_valid > 0) & (i == n_valid - 1), reward).otherwise(F.lit(0.0)))
