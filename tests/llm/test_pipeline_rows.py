"""Rows of every pipeline stage against plain Python over the stage's own input."""

import base64
import math
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from conftest import SF_SMALL
from rungkit.llm import mixing, quality
from rungkit.llm.common import read, saved, uniform_open

from .test_dedup import components, slow_fingerprint, slow_removal


@pytest.fixture(scope="module")
def stages(ready):
    """[(docs before, rows after)] of each stage."""
    docs, out = read(ready, SF_SMALL, "documents"), []
    for name, stage in cp.STAGES:
        after = saved(stage(ready, docs, SF_SMALL), f"rows-{name}")
        out.append((docs.collect(), after.collect(), docs))
        docs = after
    return out


def rows(x):
    return Counter(tuple(r) for r in x)


def test_quality(ready, stages):
    before, after, docs = stages[0]
    label = {}
    for r in read(ready, SF_SMALL, "labels").collect():
        if r.doc_id is not None and r.quality is not None:
            label[r.doc_id] = min(label.get(r.doc_id, 1), r.quality)
    raw, target = np.ones(quality.BUCKETS), np.ones(quality.BUCKETS)
    for r in before:
        np.add.at(raw, quality.ngram_buckets(r.text), 1)
        if label.get(r.doc_id) == 1:
            np.add.at(target, quality.ngram_buckets(r.text), 1)
    w = np.log(target / target.sum()) - np.log(raw / raw.sum())
    u = {r.doc_id: r.u for r in docs.select("doc_id", uniform_open(F.col("doc_id"), F.xxhash64("text"), seed=quality.SEED).alias("u")).collect()}
    key = {r.doc_id: float(w[quality.ngram_buckets(r.text)].sum()) - math.log(-math.log(u[r.doc_id])) for r in before}
    share = np.mean([v == 1 for v in label.values()])
    k = round(min(1.0, share + 1.96 * math.sqrt(share * (1 - share) / len(label))) * len(before))
    kept = sorted(key, key=key.get, reverse=True)[:k]
    assert rows(after) == rows(r for r in before if r.doc_id in set(kept)) and 0 < k < len(before)


def test_near_duplicates(stages):
    before, after, _ = stages[1]
    before = sorted(before, key=lambda r: r.doc_id)
    f = np.array([slow_fingerprint(r.text) for r in before], dtype=np.uint64)
    comp = components(len(f), zip(*np.nonzero(np.bitwise_count(f[:, None] ^ f[None, :]) <= cp.MAX_BITS)))
    assert rows(after) == rows(before[c] for c in set(comp)) and len(after) < len(before)


def test_repeats(stages):
    before, after, _ = stages[2]
    cut = [k.decode("utf-8", "ignore") for k, _, _ in slow_removal([r.text for r in before], cp.REPEAT_BYTES)]
    want = Counter((r.doc_id, c, r.lang, r.source, len(c)) for r, c in zip(before, cut))
    assert Counter((r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in after) == want
    assert any(r.text != c for r, c in zip(before, cut))


def test_mixing(stages):
    before, after, docs = stages[3]
    rates, report = mixing.fit_rates(docs, "doc_id", "text", "source", exponent=cp.MIX_EXPONENT, min_rate=1.0, max_rate=cp.MIX_MAX_RATE)
    rate = {r.doc_id: r.rate for r in rates.collect()}
    u = {r.doc_id: r.u for r in docs.select("doc_id", uniform_open(F.col("doc_id"), F.xxhash64("text"), seed=mixing.SEED).alias("u")).collect()}
    want = Counter()
    for r in before:
        n = math.floor(rate[r.doc_id]) + (u[r.doc_id] < rate[r.doc_id] - math.floor(rate[r.doc_id]))
        n = n if (r.text or "").split() else 1
        assert 1 <= n <= cp.MIX_MAX_RATE
        want[tuple(r)] += n
    assert rows(after) == want and len(after) <= 1.5 * len(before)


def test_tokens(stages):
    import tiktoken
    before, after, _ = stages[4]
    with open(P.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = Counter((r.doc_id, np.array(library.encode_ordinary(r.text or ""), "<u4").tobytes()) for r in before)
    assert Counter((r.doc_id, bytes(r.ids)) for r in after) == want
    assert all(r.same_text and r.n_tokens == len(r.ids) // 4 for r in after)


def test_stages_on_awkward_rows(ready, awkward):
    """Nulls, empty and long texts, copies, repeated rows, clashing names."""
    docs = saved(awkward.withColumn("n_chars", F.length("text").cast("bigint")), "awkward")
    before = docs.collect()
    names = docs.columns
    at = {n: names.index(n) for n in names}
    # quality: without a label for any of them every document stays
    kept = cp.filter_quality(ready, docs.withColumn("doc_id", F.col("doc_id") + 10 ** 9), SF_SMALL)
    assert kept.columns == names and kept.count() == len(before)
    # near duplicates: of equal texts the smallest id; no words are one group
    got = cp.drop_near_duplicates(ready, docs, SF_SMALL).collect()
    assert sorted((r.doc_id or -1) for r in got) == [-1, 1, 3, 6, 7, 8, 9]
    # repeats: only the long text repeats itself; null stays null, all columns stay
    got = cp.cut_repeats(ready, docs, SF_SMALL).collect()
    cut = [None if r.text is None else k.decode("utf-8", "ignore")
           for r, (k, _, _) in zip(before, slow_removal([r.text for r in before], cp.REPEAT_BYTES))]
    want = [tuple(c if i == at["text"] else (r.n_chars if c is None else len(c)) if i == at["n_chars"] else v for i, v in enumerate(r))
            for r, c in zip(before, cut)]
    assert rows(got) == Counter(want)
    # mixing: every row at least once, none more often than the bound; a null or empty text has no tokens and stays once
    got = Counter(tuple(r) for r in cp.mix_sources(ready, docs, SF_SMALL).collect())
    times = rows(before)
    assert got.keys() == times.keys()
    assert all(times[k] <= n <= times[k] ** 2 * cp.MIX_MAX_RATE for k, n in got.items())
    assert all(got[k] == times[k] for k in got if not (k[at["text"]] or "").split())
    # tokens: one row per row
    got = cp.tokenize(ready, docs, SF_SMALL).collect()
    assert len(got) == len(before) and all(r.same_text for r in got)
    assert all(r.n_tokens == 0 for r in got if r.doc_id in (3, 4))
