"""Mixing sources to target weights, DataFrame functions only.

Soft membership: a naive Bayes classifier over hashed words is counted on the
rows whose domain is known (each word bucket has a log ratio for every domain)
and predicts a posterior over domains for every document; a recorded domain is trusted to ``trust`` and the posterior shares
the rest, so a document belongs to several domains in part.  Nonnegative
document rates r are then fitted by projected-gradient least squares so that
the expected token totals  sum_d r_d * tokens_d * p(domain | d)  match the
targets: of all rates that come nearest to them, those least changed,
    r = min(max_rate, max(min_rate, start - p . lambda)).
The multipliers lambda minimise a convex function whose gradient is what the
totals miss; each step follows that gradient in the metric M of the rates that
are free to move (the inverse of the domains' second moments over them), is
projected on the box ``min_rate`` to ``max_rate`` by the formula above, and is
halved while the function does not fall.  One aggregate over all documents
evaluates a step (a total for every domain and the moments; beyond
FULL_METRIC domains only the moments' row sums, which bound them, so that a
step costs one sum a domain).  Iteration ends when the totals are met or when
a smaller weight of the rates' own change no longer brings them nearer (targets
that rates within the box cannot reach: then the totals are the nearest ones in
least squares); the report says which, and says so too if MAX_STEPS ended it.

No document is repeated more than ``max_rate`` times, however far the targets
are: without that bound, targets that are out of reach by a hair are approached
by heaping all of the difference on a few documents.

The classifier is counted on every row with a domain (a count for each bucket
and domain); posteriors, totals and rates cover all documents and whole texts.  The posterior uses the mean log likelihood ratio of the words
times ``EVIDENCE_WORDS``, since words of a text are far from independent.

Edge cases: a null or empty text has no tokens, a prior posterior and the
rate 1 before fitting, and adds nothing to any total; a null domain is
unknown; without any known domain all rates are 1; targets for domains
without documents are unreachable and reported by :func:`totals`; repeated
rows each get their rate (equal, since it depends on domain and text only);
an empty table gives an empty table.  More than ``MAX_DOMAINS`` domains raise
(each is a column).
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rungkit.llm.common import keyed, saved, uniform_open

BUCKETS = 2048
MAX_DOMAINS = 2048       # the classifier's table is BUCKETS x MAX_DOMAINS numbers at most
FULL_METRIC = 64         # domains up to which all second moments are summed
MAX_RATE = 8.0
ROOM = 1.1               # with a floor: the mixture's tokens over the least that the floor allows
EVIDENCE_WORDS = 20.0
TRUST = 0.9
TOLERANCE = 1e-6         # of the mixture's tokens
#: weights of unchanged rates against totals, of the tokens a domain; from each
#: to the next the multipliers start where they were or scaled by their ratio
SLACKS = (1e-3, 1e-5, 1e-7, 1e-9)
LEAST_GAIN = 0.99        # what is missed has to fall to so much of it, or it is the least
MAX_STEPS = 30           # at one weight; ten times as many without the full metric
MAX_HALVINGS = 12
SEED = 7


def _words(text: Column) -> Column:
    """Runs of non-space characters; empty strings may stand at the ends."""
    return F.split(text, r"\s+")


def _bucket(word: Column) -> Column:
    """Hash bucket of a word, null for the empty string."""
    return F.when(word != "", F.pmod(F.xxhash64(word), F.lit(BUCKETS)).cast("int"))


def posteriors(df: DataFrame, id_col: str, text_col: str, domain_col: str, trust: float = TRUST) -> tuple[DataFrame, list]:
    """Rows (c0 id, c2 domain, h text hash, tokens, p0..pK-1) saved, and the domains."""
    rows = keyed(df, id_col, text_col, domain_col).withColumn("h", F.xxhash64("c1"))
    found = (rows.where("c2 is not null").groupBy("c2").count().orderBy("c2").limit(MAX_DOMAINS + 1).collect())
    if len(found) > MAX_DOMAINS:
        raise ValueError(f"more than {MAX_DOMAINS} domains")
    domains, n = [r["c2"] for r in found], [r["count"] for r in found]
    if not domains:
        tokens = F.size(F.filter(_words(F.coalesce("c1", F.lit(""))), lambda w: w != ""))
        return saved(rows.select("c0", "c2", "h", tokens.cast("bigint").alias("tokens")), "mix-rows"), []
    place = F.create_map(*[x for k, d in enumerate(domains) for x in (F.lit(d), F.lit(k))])
    model = (rows.where("c2 is not null")
             .withColumn("k", F.element_at(place, F.col("c2")))         # once a row, not once a word
             .select("k", F.explode(_words(F.lower("c1"))).alias("w"))
             .groupBy(_bucket(F.col("w")).alias("bucket"), "k").count().where("bucket is not null"))
    counts = np.ones((BUCKETS, len(domains)))
    for r in model.collect():                     # at most BUCKETS x domains rows
        counts[r["bucket"], r["k"]] += r["count"]
    # how much more likely a word is in each domain than overall
    ratio = np.log(counts / counts.sum(axis=0)) - np.log(counts.sum(axis=1) / counts.sum())[:, None]
    names = [f"s{k}" for k in range(len(domains))]
    table = df.sparkSession.createDataFrame([(i, *map(float, r)) for i, r in enumerate(ratio)],
                                            "bucket int, " + ", ".join(f"{s} double" for s in names))
    words = (rows.withColumn("row", F.monotonically_increasing_id()).withColumn("own", F.element_at(place, F.col("c2")))
             .select("row", "c0", "own", "h", F.explode_outer(_words(F.lower("c1"))).alias("word"))
             .select("row", "c0", "own", "h", _bucket(F.col("word")).alias("bucket")))
    # a text leaves its map task as one partial sum for every domain; grouping
    # by what belongs to the row keeps the aggregate a hash aggregate (a
    # first() of a string would sort every word)
    sums = (words.join(F.broadcast(table), "bucket", "left").groupBy("row", "c0", "own", "h")
            .agg(F.count("bucket").alias("tokens"), *[F.sum(s).alias(s) for s in names]))
    total = sum(n)
    logit = [F.lit(math.log(c / total)) + F.when(F.col("tokens") > 0, F.col(s) * EVIDENCE_WORDS
                                                / F.greatest(F.col("tokens"), F.lit(1))).otherwise(F.lit(0.0))
             for s, c in zip(names, n)]
    sums = sums.select("c0", "own", "h", "tokens", *[x.alias(s) for x, s in zip(logit, names)])
    top = F.greatest(*names, F.lit(-math.inf)) if names else None
    sums = sums.select("c0", "own", "h", "tokens", *[F.exp(F.col(s) - top).alias(s) for s in names])
    norm = sum((F.col(s) for s in names[1:]), F.col(names[0]))
    post = []
    for k, s in enumerate(names):
        soft = F.col(s) / norm
        sure = F.when(F.col("own") == k, F.lit(trust)).otherwise(F.lit(0.0))
        post.append(F.when(F.col("own").isNull(), soft).otherwise(sure + (1 - trust) * soft).alias(f"p{k}"))
    name = F.element_at(F.array(*[F.lit(d) for d in domains]), F.col("own") + 1)
    return saved(sums.select("c0", F.when(F.col("own").isNotNull(), name).alias("c2"), "h", F.col("tokens").cast("bigint").alias("tokens"), *post), "mix-rows"), domains


def totals(rows: DataFrame, n_domains: int, rate: Column) -> np.ndarray:
    """Expected tokens of every domain (one row reaches the driver)."""
    r = rows.agg(*[F.sum(rate * F.col("tokens") * F.col(f"p{k}")) for k in range(n_domains)]).first()
    return np.array([x or 0.0 for x in r])


def _moved(n: int, start: float, pull: np.ndarray) -> Column:
    """start - p . pull"""
    return F.lit(start) - sum((F.col(f"p{k}") * F.lit(float(pull[k])) for k in range(1, n)), F.col("p0") * F.lit(float(pull[0])))


def _state(rows: DataFrame, n: int, start: float, pull: np.ndarray, floor: float, top: float) -> tuple[float, np.ndarray, np.ndarray]:
    """At the multipliers ``pull``: the convex function's sum over documents,
    the totals, and the moments sum tokens p p' over the rates strictly within
    the box, or their row sums (one row reaches the driver)."""
    full = n <= FULL_METRIC
    cells = [(i, j) for i in range(n) for j in range(i, n if full else i + 1)]
    p = [F.col(f"p{k}") for k in range(n)]
    low, high = F.lit(float(floor)), F.lit(float(top))
    rows = rows.select("tokens", *p, _moved(n, start, pull).alias("u")).withColumn(
        "free", F.when((F.col("u") >= low) & (F.col("u") <= high), F.col("tokens")).otherwise(F.lit(0))).withColumn(
        "r", F.least(high, F.greatest(low, F.col("u"))))
    r = rows.agg(F.sum(F.col("tokens") * F.col("r") * (F.col("u") - F.col("r") / 2)),
                 *[F.sum(F.col("r") * F.col("tokens") * x) for x in p],
                 *[F.sum(F.col("free") * p[i] * (p[j] if full else F.lit(1.0))) for i, j in cells]).first()
    out = np.zeros((n, n))
    for (i, j), x in zip(cells, r[n + 1:]):
        out[i, j] = out[j, i] = x or 0.0
    return r[0] or 0.0, np.array([x or 0.0 for x in r[1:n + 1]]), out


class Report(dict):
    """{domain: (target, reached)} in tokens.  ``met``: every target within
    TOLERANCE of the mixture; ``ended``: 'met', 'nearest' (no rates in the box
    come nearer) or 'steps' (stopped before either)."""

    def __init__(self, domains: list, goal, reached, ended: str, steps: int):
        super().__init__((d, (float(g), float(x))) for d, g, x in zip(domains, goal, reached))
        self.ended, self.steps, self.met = ended, steps, ended == "met"


def tempered_targets(weights: dict, exponent: float) -> dict:
    """Shares raised to ``exponent`` (0: equal, 1: as they are), summing to 1."""
    up = {d: w ** exponent if w > 0 else 0.0 for d, w in weights.items()}
    total = sum(up.values())
    return {d: w / total for d, w in up.items()} if total else {}


def fit_rates(df: DataFrame, id_col: str, text_col: str, domain_col: str, target: dict | None = None,
              exponent: float = 0.7, budget: float | None = None, min_rate: float = 0.0,
              trust: float = TRUST, max_rate: float = MAX_RATE) -> tuple[DataFrame, Report]:
    """One row per input row: ``id_col``, ``domain``, ``text_hash``,
    ``tokens``, ``rate``; and a :class:`Report`.

    Tokens are runs of non-space characters (a text without spaces has one).
    ``target``: share of each domain in the mixture; None: the expected
    shares tempered by ``exponent``.  ``budget``: tokens of the mixture; None:
    as many as there are, or, where ``min_rate`` is 1 or more, ROOM times the
    least that gives every domain ``min_rate`` times its tokens.  Rates lie
    between ``min_rate`` and ``max_rate``.
    """
    if not 0 <= min_rate <= max_rate:
        raise ValueError("0 <= min_rate <= max_rate is needed")
    rows, domains = posteriors(df, id_col, text_col, domain_col, trust)
    n = len(domains)
    start = float(min(max(1.0, min_rate), max_rate))
    have = totals(rows, n, F.lit(1.0)) if n else np.zeros(0)
    if not have.sum():
        return _named(rows, id_col, F.lit(start)), Report([], [], [], "met", 0)
    if target is None:
        target = tempered_targets(dict(zip(domains, have)), exponent)
    share = np.array([float(target.get(d, 0.0)) for d in domains])
    if share.min() < 0 or not share.sum():
        raise ValueError("targets must be nonnegative with a positive sum")
    share = share / share.sum()
    if budget is None:
        budget = have.sum()
        if min_rate >= 1:
            budget = ROOM * min_rate * max(h / s for h, s in zip(have, share) if s > 0)
    goal = share * budget
    at = lambda pull: _state(rows, n, start, pull, min_rate, max_rate)
    pull, missed, steps, ended, before = np.zeros(n), math.inf, 0, "", None
    state = at(pull)
    best = pull, state
    for weight in SLACKS:
        slack = weight * have.sum() / n
        value = lambda pull, state: state[0] + pull @ goal + slack * (pull @ pull) / 2
        if before:                                     # out of reach, the multipliers grow as the weight falls
            far = pull * (before / weight)
            there = at(far)
            if value(far, there) < value(pull, state):
                pull, state = far, there
        pull, state, ended, k = _descend(pull, state, at, value, goal, slack, MAX_STEPS * (1 if n <= FULL_METRIC else 10))
        steps, miss = steps + k, np.linalg.norm(state[1] - goal)
        gain, before = miss <= LEAST_GAIN * missed, weight
        if miss < missed:
            missed, best = miss, (pull, state)
        if ended in ("met", "steps") or not gain:
            break
    pull, (_, got, _) = best
    rate = F.least(F.lit(float(max_rate)), F.greatest(F.lit(float(min_rate)), _moved(n, start, pull)))
    return _named(rows, id_col, rate), Report(domains, goal, got, ended, steps)


def _descend(pull: np.ndarray, state: tuple, at, value, goal: np.ndarray, slack: float, most: int) -> tuple:
    """Projected-gradient steps at one weight: (multipliers, their state, how
    it ended, steps)."""
    tolerance = TOLERANCE * goal.sum()
    for k in range(most):
        _, got, moments = state
        ahead = got - goal - slack * pull              # minus the gradient
        if np.abs(got - goal).max() <= tolerance:
            return pull, state, "met", k
        if np.abs(ahead).max() <= tolerance:
            return pull, state, "nearest", k
        move = np.linalg.solve(moments + slack * np.eye(len(goal)), ahead)
        here, slope = value(pull, state), ahead @ move
        for halved in range(MAX_HALVINGS + 1):
            step = pull + move / 2 ** halved
            there = at(step)
            if value(step, there) <= here - 1e-4 * slope / 2 ** halved:
                pull, state = step, there
                break
        else:                                          # nothing falls any more in double precision
            return pull, state, "nearest", k + 1
    return pull, state, "steps", most


def _named(rows: DataFrame, id_col: str, rate: Column) -> DataFrame:
    return rows.select(F.col("c0").alias(id_col), F.col("c2").alias("domain"), F.col("h").alias("text_hash"),
                       "tokens", rate.cast("double").alias("rate"))


def copies(rate: Column, *key: Column, seed: int = SEED) -> Column:
    """Whole number of copies with expectation ``rate``."""
    whole = F.floor(rate)
    return whole + (uniform_open(*key, seed=seed) < rate - whole).cast("bigint")
