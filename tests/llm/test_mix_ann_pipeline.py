import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
import corpus_pipeline
from conftest import SF_MID, SF_SMALL
from rungkit.llm import ann, mixing
from rungkit.llm.common import read, saved


def test_rates_meet_targets(ready):
    docs = read(ready, SF_MID, "documents")
    rates, report = mixing.fit_rates(docs, "doc_id", "text", "source", exponent=0.3)
    assert rates.count() == docs.count() and rates.where("rate < 0").count() == 0
    assert all(abs(a - b) <= 1e-4 * sum(x for x, _ in report.values()) for a, b in report.values())
    plan = rates._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("rows,names", [
    ([(1, "a b c", "x"), (2, "a a d", "x"), (3, "e f", "y"), (4, "e e f g", None), (5, None, "y"), (6, "", None)], ["x", "y"]),
    ([(1, "a b c", "x"), (2, "a a d", "x"), (3, "e f a", "y"), (4, "e e f g", None), (5, "b g h", "z"),
      (6, "a e g", None), (7, None, "y"), (8, "", None)], ["x", "y", "z"])])
def test_posteriors_equal_brute_force(ready, rows, names):
    df = ready.createDataFrame(rows, "doc_id bigint, text string, source string")
    got, domains = mixing.posteriors(df, "doc_id", "text", "source", trust=0.9)
    assert domains == names
    bucket = {r.w: r.b for r in ready.createDataFrame([(w,) for w in "abcdefgh"], "w string")
              .select("w", mixing._bucket(F.col("w")).alias("b")).collect()}
    count = np.ones((mixing.BUCKETS, len(names)))
    for _, t, s in rows:
        for w in (t or "").split():
            if s:
                count[bucket[w], domains.index(s)] += 1
    prior = np.array([sum(s == d for _, _, s in rows) for d in names])
    logp = np.log(count / count.sum(axis=0))
    for r in got.collect():
        _, t, s = rows[r.c0 - 1]
        w = [bucket[x] for x in (t or "").split()]
        z = np.log(prior / prior.sum()) + (logp[w].mean(axis=0) * mixing.EVIDENCE_WORDS if w else 0)
        p = np.exp(z - z.max())
        p /= p.sum()
        if s:
            p = 0.9 * (np.array(domains) == s) + 0.1 * p
        assert np.allclose([r[f"p{k}"] for k in range(len(names))], p) and r.tokens == len(w)


def test_small_sources_are_counted(ready):
    n = F.col("id")
    rows = ready.range(200_000).select(
        n.alias("doc_id"),
        F.when(n < 4, "red red red red").when(n < 8, "blue blue blue blue").when(n < 9, "red red").when(n < 10, "blue blue")
        .otherwise(F.concat(F.lit("green word"), n)).alias("text"),
        F.when(n < 4, "r").when(n < 8, "b").when(n < 10, None).otherwise("g").alias("source"))
    got, domains = mixing.posteriors(rows, "doc_id", "text", "source")
    assert domains == ["b", "g", "r"]
    p = {r.c0: r for r in got.where("c0 in (8, 9)").collect()}
    assert p[8].p2 > 0.9 and p[9].p0 > 0.9


def test_projected_gradient_with_floor(ready):
    rng = np.random.default_rng(1)
    rows = [(i, "w " * int(rng.integers(1, 50)), "abc"[min(int(rng.integers(0, 5)), 2)]) for i in range(200)]
    df = ready.createDataFrame(rows, "doc_id bigint, text string, source string")
    rates, report = mixing.fit_rates(df, "doc_id", "text", "source", target={"a": 1, "b": 1, "c": 1}, min_rate=1.0, trust=1.0)
    assert rates.where("rate < 1").count() == 0
    assert max(abs(a - b) / a for a, b in report.values()) < 0.01


def test_floor_with_soft_memberships(ready):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(600):
        k = max(0, int(rng.integers(0, 6)) - 2)
        words = [f"w{k if rng.random() < 0.2 else rng.integers(0, 4)}x{rng.integers(0, 9)}" for _ in range(rng.integers(5, 60))]
        rows.append((i, " ".join(words), "abcd"[k]))
    df = ready.createDataFrame(rows, "doc_id bigint, text string, source string")
    rates, report = mixing.fit_rates(df, "doc_id", "text", "source", exponent=0.3, min_rate=1.0)
    assert rates.where("rate < 1").count() == 0
    goal, reached = (np.array(x) for x in zip(*report.values()))
    got = mixing.posteriors(df, "doc_id", "text", "source")[0].collect()
    p, tokens = np.array([[r[f"p{k}"] for k in range(4)] for r in got]), np.array([r.tokens for r in got])
    part = p * tokens[:, None]
    least = np.linalg.norm(part.T @ box_fit(part, p, goal, 1.0, mixing.MAX_RATE) - goal)
    assert np.linalg.norm(reached - goal) <= 1.05 * least + 1e-5 * goal.sum()


def box_fit(part, p, goal, low, high, steps=20_000):
    """Accelerated projected gradient on every rate."""
    lip = np.linalg.eigvalsh(part.T @ p).max()
    r = y = np.ones(len(p))
    t = 1.0
    for _ in range(steps):
        new = np.clip(y - p @ (part.T @ y - goal) / lip, low, high)
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        r, y, t = new, new + (t - 1) / after * (new - r), after
    return r


def test_rates_stay_in_the_box_and_come_nearest(ready):
    rng = np.random.default_rng(9)
    # long texts of one source, texts of one word of another: out of reach without huge rates
    rows = [(i, " ".join(f"w{x}" for x in rng.integers(0, 40, 200)), "a") for i in range(60)]
    rows += [(100 + i, f"w{rng.integers(0, 40)}", "b") for i in range(40)]
    df = ready.createDataFrame(rows, "doc_id bigint, text string, source string")
    rates, report = mixing.fit_rates(df, "doc_id", "text", "source", exponent=0.3, min_rate=1.0, max_rate=3.0)
    got = [r.rate for r in rates.collect()]
    assert min(got) >= 1 and max(got) <= 3 and not report.met and report.ended == "nearest"
    post = mixing.posteriors(df, "doc_id", "text", "source")[0].collect()
    p, tokens = np.array([[r.p0, r.p1] for r in post]), np.array([r.tokens for r in post])
    part = p * tokens[:, None]
    goal, reached = (np.array(x) for x in zip(*report.values()))
    best = part.T @ box_fit(part, p, goal, 1, 3)
    assert np.linalg.norm(reached - goal) <= 1.001 * np.linalg.norm(best - goal) + 1e-6 * goal.sum()


def test_nearly_equal_sources_are_not_blown_up(ready):
    docs = read(ready, SF_MID.replace("0.01", "0.1"), "documents")
    rates, report = mixing.fit_rates(docs, "doc_id", "text", "source", exponent=0.9, min_rate=1.0, max_rate=corpus_pipeline.MIX_MAX_RATE)
    got = rates.select(F.max("rate"), F.avg("rate")).first()
    assert report.met and got[0] <= 3 and got[1] < 1.5


def test_many_sources(ready):
    n = F.col("id")
    rows = ready.range(2000).select(n.alias("doc_id"), F.concat_ws(" ", F.concat(F.lit("w"), n % 90), F.concat(F.lit("v"), n % 7)).alias("text"),
                                    F.concat(F.lit("s"), F.least(n % 90, n % 80)).alias("source"))
    rates, report = mixing.fit_rates(rows, "doc_id", "text", "source", exponent=0.5)
    assert len(report) == 80 > mixing.FULL_METRIC and report.met
    assert rates.count() == 2000


def test_mixing_edge_cases(ready, awkward, nothing):
    rates, report = mixing.fit_rates(awkward, "doc_id", "text", "source")
    assert rates.count() == awkward.count() and set(report) == {"a", "b", "c"}
    blank = awkward.withColumn("source", F.lit(None).cast("string"))
    assert {r.rate for r in mixing.fit_rates(blank, "doc_id", "text", "source")[0].collect()} == {1.0}
    assert mixing.fit_rates(nothing, "doc_id", "text", "source")[0].count() == 0
    got = ready.range(20000).select(F.avg(mixing.copies(F.lit(1.3), F.col("id")))).first()[0]
    assert abs(got - 1.3) < 0.02


def slow_nearest(rows, query, k=5):
    from rungkit.llm.embed_dedup import as_vector
    v = {i: as_vector(x) for i, x in rows if i is not None and as_vector(x) is not None}
    s = [(-ann.cosine(v[query], v[i]), i) for i in v if i != query and len(v[i]) == len(v[query])]
    return [i for _, i in sorted(s)[:k]]


def test_neighbours_recall(ready):
    rows = [(r.vec_id, r.embedding) for r in read(ready, SF_SMALL, "embeddings").collect()]
    got = {}
    for r in E.queries()["op2_nearest_neighbours"](ready, SF_SMALL).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    asked = [i for i, _ in rows if i % 50 == 0]
    assert set(got) == set(asked)
    hits = sum(len(set(got[q]) & set(slow_nearest(rows, q))) for q in asked)
    assert hits >= 0.9 * 5 * len(asked)


def test_neighbours_recall_in_a_crowd(ready):
    rng = np.random.default_rng(3)
    one = rng.standard_normal(64)
    crowd = one + rng.standard_normal((2000, 64)) * 1e-4
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([crowd, rng.standard_normal((1000, 64))]))]
    df = ready.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = {}
    for r in ann.nearest_neighbours(df, "vec_id", "embedding", F.col("c0") % 50 == 0).collect():
        got.setdefault(r.query_id, []).append(r.id)
    asked = range(0, 2000, 50)
    hits = sum(len(set(got[q]) & set(slow_nearest(rows, q))) for q in asked)
    assert hits >= 0.9 * 5 * len(asked), hits / (5 * len(asked))


def test_very_small_and_large_components(ready):
    rows = [(0, [1e-200, 0.0, 0.0]), (1, [1e200, 1e200, 0.0]), (2, [0.0, 5e-324, 0.0]), (3, [1e300, 0.0, 1e300]), (4, [-1.0, 0.0, 1e-300]),
            (50, [2.0, 2.0, 1.0])]
    df = ready.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = {}
    for r in ann.nearest_neighbours(df, "vec_id", "embedding", F.col("c0") % 50 == 0).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.id, r.score))
    want = {0: [(1, 2 ** -0.5), (3, 2 ** -0.5), (50, 2 / 3), (2, 0.0), (4, -1.0)],
            50: [(1, 4 / 3 / 2 ** 0.5), (3, 3 / 3 / 2 ** 0.5), (0, 2 / 3), (2, 2 / 3), (4, -2 / 3)]}
    for q, rows in want.items():
        ids, scores = zip(*[(i, s) for _, i, s in sorted(got[q])])
        assert np.allclose(scores, [s for _, s in rows])
        assert sorted(ids) == sorted(i for i, _ in rows) and ids[-1] == rows[-1][0]


def test_clashing_columns(ready):
    from rungkit.llm import embed_dedup
    rows = [(i, [float(i % 7), 1.0, float(i % 3)]) for i in range(120)]
    plain = ready.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    clash = plain.select("*", *[F.lit("x").alias(c) for c in ("c0", "c1", "key", "vec", "node", "u", "v", "sim", "new", "query", "ids", "salt",
                                                              "cell", "n", "component", "group", "id", "score", "rank")])
    near = lambda d: sorted(map(tuple, ann.nearest_neighbours(d, "vec_id", "embedding", F.col("c0") % 50 == 0).collect()))
    dup = lambda d: sorted((r.vec_id, r.n_links, r.component_id) for r in embed_dedup.near_duplicates(d, "vec_id", "embedding", 0.9).collect())
    assert near(plain) == near(clash) and dup(plain) == dup(clash)


def test_old_pairs_are_not_compared_again(ready):
    vec = [np.array(v, dtype=float).tobytes() for v in ([1, 0], [0.8, 0.6], [0.6, 0.8])]
    met = [[(i, -1.0, bytearray(v), i == 2) for i, v in enumerate(vec)]]
    groups = ready.createDataFrame([(m,) for m in met], "met array<struct<node:bigint,worst:double,vec:binary,new:boolean>>")
    got = sorted((r.u, r.v) for r in ann._meet(groups, 6).collect())
    assert got == [(0, 2), (1, 2), (2, 0), (2, 1)]


def test_neighbours_edge_cases(ready):
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [2.0, 0.0]), (3, [0.5, 0.5]), (4, None), (5, [0.0, 0.0]),
            (6, [float("nan"), 1.0]), (7, [1.0, 1.0, 1.0]), (None, [1.0, 0.1]), (50, [1.0, None])] + \
           [(100 + i, [2.0, 0.0]) for i in range(50)]
    df = ready.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = ann.nearest_neighbours(df, "vec_id", "embedding", F.col("c0").isin(0, 2, 4, 7), k=3).orderBy("query_id", "rank").collect()
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append(r.id)
    assert by == {0: [1, 2, 100], 2: [0, 1, 100]} or by == {0: [1, 2, 100], 2: [1, 100, 101]}
    assert ann.nearest_neighbours(df.limit(0), "vec_id", "embedding", F.col("c0") == 0).count() == 0


def test_pipeline_stages(ready):
    docs = read(ready, SF_SMALL, "documents")
    names = docs.columns
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        docs = saved(stage(ready, docs, SF_SMALL), f"test-{name}")
        sizes.append(docs.count())
        if name != "tokens":
            assert docs.columns == names
    assert sizes[0] > sizes[1] > sizes[2] == sizes[3] <= sizes[4] == sizes[5]
    assert docs.where("not same_text").count() == 0


def test_pipeline_stages_on_awkward_rows(ready, awkward):
    docs = awkward.withColumn("n_chars", F.length("text").cast("bigint"))
    kept = corpus_pipeline.drop_near_duplicates(ready, docs, SF_SMALL)
    got = sorted((r.doc_id or -1, r.text or "") for r in kept.collect())
    assert [g[0] for g in got] == [-1, 1, 3, 6, 7, 8, 9] and kept.columns == docs.columns
    assert corpus_pipeline.cut_repeats(ready, docs, SF_SMALL).count() == docs.count()
    assert corpus_pipeline.mix_sources(ready, docs, SF_SMALL).select("doc_id").distinct().count() == 10
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(ready, empty, SF_SMALL).count() == 0
