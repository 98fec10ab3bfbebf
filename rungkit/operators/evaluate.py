"""Evaluation jobs: pass@k, trajectory statistics, masked token losses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rungkit.functions import text as tx
from rungkit.operators.materialize import materialize
from rungkit.operators.scan import prefix_sums


def passk(n: Column, c: Column, k: Column) -> Column:
    """Unbiased pass@k, 1 - C(n-c,k)/C(n,k), in the stable product form."""
    prod = F.aggregate(F.sequence(n - c + 1, n), F.lit(1.0),
                       lambda acc, i: acc * (F.lit(1.0) - k / i))
    return F.when((c == 0) | (n < k), F.lit(0.0)).when(c == n, F.lit(1.0)).otherwise(F.lit(1.0) - prod)


def problem_counts(rollouts: DataFrame, key: str, reward: str = "reward", threshold: float = 0.0,
                   by=()) -> DataFrame:
    """n samples and c successes (reward > threshold) per problem."""
    return rollouts.groupBy(*by, key).agg(
        F.count(F.lit(1)).cast("bigint").alias("n"),
        F.count(F.when(F.col(reward) > threshold, 1)).cast("bigint").alias("c"))


def passk_per_problem(counts: DataFrame, key: str, n_max: int) -> DataFrame:
    d = counts.select("*", F.explode(F.sequence(F.lit(1).cast("bigint"),
                                                F.least(F.lit(n_max).cast("bigint"), F.col("n")))).alias("k"))
    return d.withColumn("passk", passk(F.col("n"), F.col("c"), F.col("k")))


def passk_curve(counts: DataFrame, n_max: int, by=()) -> DataFrame:
    """Mean pass@k over the problems that have k samples.

    Problems are first grouped by their distinct (n, c) pair (at most
    n_max^2/2 pairs whatever the problem count), the k-curve is computed
    once per pair and weighted by the pair's problem count.
    """
    pairs = counts.groupBy(*by, "n", "c").agg(F.count(F.lit(1)).alias("w"))
    per = passk_per_problem(pairs, "n", n_max)
    return per.groupBy(*by, "k").agg(
        (F.sum(F.col("passk") * F.col("w")) / F.sum("w")).alias("passk"),
        F.sum("w").cast("bigint").alias("n_problems"))


# ------------------------------------------------------------ trajectories

def trajectory_matrix(ledger: DataFrame, samples: DataFrame, key: str = "sample_id") -> DataFrame:
    """Long (sample, t) matrix of run portion / mean reward, padded to the
    longest history by carrying the last run forward; NULL rows for
    samples without history."""
    runs = ledger.select(key, (F.col("run_id") - 1).alias("t"), "portion", F.col("mean_reward").alias("reward"))
    lens = ledger.groupBy(key).agg(F.max("run_id").alias("R"))
    T = lens.agg(F.max("R").alias("T"))
    grid = samples.select(key).distinct().join(lens, key, "left").crossJoin(F.broadcast(T))  # one-row side
    grid = grid.select(key, "R", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("T") - 1)).alias("t"))
    grid = grid.withColumn("_src", F.least(F.col("t"), F.col("R") - 1))
    return grid.join(runs.withColumnRenamed("t", "_src"), [key, "_src"], "left") \
               .select(key, "t", "portion", "reward")


def trajectory_runs(ledger: DataFrame, key: str = "sample_id") -> DataFrame:
    """Trajectories in run-length form: one row per run with its iteration
    ``t_from`` and ``t_to`` (null for a sample's last run, which is carried
    forward).  All that the matrix holds, in the size of the ledger."""
    lens = ledger.groupBy(key).agg(F.max("run_id").alias("_r"))
    return (ledger.join(lens, key)
            .select(key, (F.col("run_id") - 1).alias("t_from"),
                    F.when(F.col("run_id") < F.col("_r"), F.col("run_id") - 1).alias("t_to"),
                    "portion", F.col("mean_reward").alias("reward")))


def _merged(n1, m1, s1, n2, m2, s2):
    """Mean and sum of squared deviations of two parts put together (only
    non-negative terms are added, so equal values give exactly no spread)."""
    n = n1 + n2
    delta = m2 - m1
    mean = F.when(n1 == 0, m2).when(n2 == 0, m1).otherwise(m1 + delta * n2 / n)
    dev = F.when(n1 == 0, s2).when(n2 == 0, s1).otherwise(s1 + s2 + delta * delta * n1 * n2 / n)
    return mean, dev


def _sweep(runs: DataFrame, cols) -> DataFrame:
    """Per iteration t, for each of ``cols``: count, mean and squared deviations
    over all samples with history.

    Interval sweep: at t stand the runs that end there and the last runs of
    samples that ended at t or before.  The former are moments of the rows at t;
    the latter are prefix merges of the moments of those that ended at each
    iteration: their counts and means by prefix sums, and the deviations as the
    prefix sum of what each merge adds.
    """
    def moments(df, by, tag):
        aggs = [F.count(F.lit(1)).alias(f"{tag}n")]
        for c in cols:
            aggs += [F.avg(c).alias(f"{tag}m_{c}"), (F.var_pop(c) * F.count(c)).alias(f"{tag}s_{c}")]
        return df.groupBy(F.col(by).alias("t")).agg(*aggs)

    passing = moments(runs.filter("t_to is not null"), "t_from", "p")
    ended = moments(runs.filter("t_to is null"), "t_from", "e")
    top = runs.agg(F.max("t_from").alias("top"))                  # one row
    ts = top.select(F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("top"))).alias("t"))
    at = materialize(ts.join(ended, "t", "left").join(passing, "t", "left"), "sweep")
    for c in cols:
        at = at.withColumn(f"ew_{c}", F.coalesce(F.col("en") * F.col(f"em_{c}"), F.lit(0.0)))
    at = prefix_sums(at, "t", {"N": "en", **{f"W_{c}": f"ew_{c}" for c in cols}})
    own = F.coalesce(F.col("en"), F.lit(0))
    before = F.col("N") - own
    for c in cols:
        m0 = (F.col(f"W_{c}") - F.col(f"ew_{c}")) / F.nullif(before, F.lit(0))
        delta = F.col(f"em_{c}") - m0
        add = F.when(own > 0, F.col(f"es_{c}") + F.when(before > 0, delta * delta * before * own / F.col("N")).otherwise(F.lit(0.0)))
        at = at.withColumn(f"add_{c}", F.coalesce(add, F.lit(0.0)))
    at = prefix_sums(at, "t", {f"D_{c}": f"add_{c}" for c in cols})
    n1, n2 = F.coalesce(F.col("pn"), F.lit(0)), F.col("N")
    out = [F.col("t"), (n1 + n2).cast("bigint").alias("n")]
    for c in cols:
        mean, dev = _merged(n1, F.col(f"pm_{c}"), F.col(f"ps_{c}"), n2, F.col(f"W_{c}") / F.nullif(n2, F.lit(0)), F.col(f"D_{c}"))
        out += [mean.alias(f"{c}_mean"), F.sqrt(dev / (n1 + n2)).alias(f"{c}_std")]
    return at.select(*out)


def trajectory_bands(ledger: DataFrame, key: str = "sample_id", clip: bool = True) -> DataFrame:
    """Per iteration t: mean and population std of portion and reward over
    samples with history, band = mean +- std (clipped to [0, 1])."""
    runs = materialize(trajectory_runs(ledger, key), "trajectory_runs")
    out = _sweep(runs, ["portion", "reward"])
    for c in ("portion", "reward"):
        lo = F.col(f"{c}_mean") - F.col(f"{c}_std")
        hi = F.col(f"{c}_mean") + F.col(f"{c}_std")
        if clip:
            lo, hi = F.greatest(lo, F.lit(0.0)), F.least(hi, F.lit(1.0))
        out = out.withColumns({f"{c}_lo": lo, f"{c}_hi": hi})
    return out


def token_loss_metrics(tokens: DataFrame, batch: str = "batch", loss: str = "loss", mask: str = "mask") -> DataFrame:
    """Masked mean loss per (micro-)batch and the unweighted mean of batch means."""
    m = F.col(mask).cast("double")
    per = tokens.groupBy(batch).agg(
        F.count(F.lit(1)).cast("bigint").alias("n_tokens"),
        F.sum(m).cast("bigint").alias("n_valid"),
        (F.sum(F.col(loss) * m) / (F.sum(m) + F.lit(1e-8))).alias("masked_mean"))
    overall = per.agg(F.avg("masked_mean").alias("val_mean"))
    return per.crossJoin(F.broadcast(overall))   # one-row side


# ------------------------------------------------------------ ratio grid

def reveal(text: Column, ratios: list[float]) -> Column:
    """``array<struct<ratio, cut, shown>>``: the text cut at each ratio of its
    ``\\S+\\s*`` chunks.  The chunks' lengths are worked out once; a cut is
    the sum of the first of them, a place in the text, and the shown part a
    substring: no ratio splits or joins the text again."""
    lens = F.transform(tx.chunks(text), lambda c: F.length(c))
    n = F.size(lens)
    out = []
    for r in ratios:
        cut = F.floor(n * F.lit(float(r))).cast("int")
        at = F.aggregate(F.slice(lens, F.lit(1), cut), F.lit(0), lambda a, x: a + x)
        out.append(F.struct(F.lit(float(r)).alias("ratio"), cut.alias("cut"), at.alias("at")))
    return F.array(*out)


def ratio_grid(problems: DataFrame, completions: DataFrame, key: str, ratios: list[float], rewards: dict) -> DataFrame:
    """Ratio x question x sample grid: ``problems`` (key, answer,
    ground_truth), ``completions`` (key, sample_no, completion), ``rewards``
    {name: fn(solution, truth) -> double column}.

    One row per (question, ratio) with one array per reward, in sample order:
    the revealed part of the answer followed by what the sample has from the
    same chunk on, scored by every reward.  A ratio that reveals nothing
    scores the whole completion.
    """
    p = problems.select(key, "answer", "ground_truth", F.explode(reveal(F.col("answer"), ratios)).alias("r"))
    p = p.select(key, "ground_truth", "r.ratio", "r.cut", F.expr("substring(answer, 1, r.at)").alias("shown"))
    c = completions.select(F.col(key).alias("_k"), "sample_no", "completion")
    g = p.join(c, F.col(key) == F.col("_k")).drop("_k")
    rest = F.aggregate(F.slice(F.transform(tx.chunks(F.col("completion")), lambda x: F.length(x)), F.lit(1), F.col("cut")),
                       F.lit(0), lambda a, x: a + x)
    g = g.withColumn("_from", rest)
    g = g.withColumn("scored", F.when(F.col("cut") > 0, F.concat("shown", F.expr("substring(completion, _from + 1)"))).otherwise(F.col("completion")))
    g = g.select(key, "ratio", "sample_no", *[fn(F.col("scored"), F.col("ground_truth")).alias(f"_v_{name}") for name, fn in rewards.items()])
    samples = F.array_sort(F.collect_list(F.struct("sample_no", *[f"_v_{n}" for n in rewards])))
    g = g.groupBy(key, "ratio").agg(samples.alias("_s"))                # a question's samples
    return g.select(key, "ratio", *[F.col(f"_s._v_{name}").alias(name) for name in rewards])
