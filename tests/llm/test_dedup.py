import hashlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import __spark_entry__ as E
from conftest import SF_SMALL
from rungkit.llm import embed_dedup, induced_sort, simhash, suffix_dedup
from rungkit.llm.common import read
from rungkit.llm.components import connected_components


def components(n, pairs):
    up = list(range(n))

    def root(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x
    for a, b in pairs:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


def test_connected_components(ready):
    rng = np.random.default_rng(3)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(400, 460)] + [(0, 0)]
    got = {r.node: r.component for r in connected_components(ready.createDataFrame(pairs, "u bigint, v bigint")).collect()}
    want = components(500, pairs)
    linked = {x for a, b in pairs if a != b for x in (a, b)}
    assert got == {x: want[x] for x in linked}
    assert connected_components(ready.createDataFrame([], "u bigint, v bigint")).count() == 0


def slow_fingerprint(text, width=3):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    sh = [b" ".join(w[i:i + width]) for i in range(len(w) - width + 1)] or [b" ".join(w)]
    h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << i for i in range(64) if 2 * sum(x >> i & 1 for x in h) > len(h))


def test_fingerprints(ready, awkward):
    got = simhash.fingerprints(awkward, "doc_id", "text").collect()
    want = sorted(slow_fingerprint(r.text) for r in awkward.collect())
    assert sorted(r.fp % (1 << 64) for r in got) == want


def test_links_equal_all_pairs_also_in_crowds(ready):
    rng = np.random.default_rng(5)
    fps = {int(x) for x in rng.integers(-2 ** 63, 2 ** 63 - 1, 400)}
    for base in list(fps)[:40]:
        for _ in range(4):
            x = base
            for b in rng.integers(0, 64, int(rng.integers(1, 6))):
                x ^= (1 << int(b)) - (1 << 64 if b == 63 else 0)
            fps.add(x)
    crowd = int(rng.integers(-2 ** 62, 2 ** 62))
    for v in rng.integers(0, 1 << 14, 900):          # far more than a posting compares pairwise
        fps.add(crowd ^ (int(v) & 127) << 9 ^ (int(v) >> 7) << 40)
    fps = sorted(fps)
    u = np.array(fps, dtype=np.int64).view(np.uint64)
    near = np.bitwise_count(u[:, None] ^ u[None, :]) <= 3
    want = components(len(fps), zip(*np.nonzero(near)))
    links = simhash.fingerprint_links(ready.createDataFrame([(x,) for x in fps], "fp bigint"), 3).collect()
    assert all((r.u ^ r.v).bit_count() <= 3 or ((r.u ^ r.v) % (1 << 64)).bit_count() <= 3 for r in links)
    at = {x: i for i, x in enumerate(fps)}
    assert components(len(fps), [(at[r.u], at[r.v]) for r in links]) == want
    assert len(links) < 40 * len(fps)


def test_simhash_edge_cases(ready, awkward, nothing):
    out = simhash.near_duplicates(awkward, "doc_id", "text").collect()
    assert len(out) == awkward.count()
    by = {}
    for r in out:
        by.setdefault(r.doc_id, set()).add(r.component_id)
    assert by[1] == by[2] == {1} and by[3] == by[4] == by[5] == {3} and by[None] == {None}
    assert simhash.near_duplicates(nothing, "doc_id", "text").count() == 0


def test_op8_equals_brute_force(ready):
    docs = sorted(read(ready, SF_SMALL, "documents").select("doc_id", "text").collect())
    f = np.array([slow_fingerprint(r.text) for r in docs], dtype=np.uint64)
    comp = components(len(f), zip(*np.nonzero(np.bitwise_count(f[:, None] ^ f[None, :]) <= 3)))
    want = [(r.doc_id, f"{int(x):016x}", docs[c].doc_id) for r, x, c in zip(docs, f, comp)]
    got = E.queries()["op8_simhash"](ready, SF_SMALL).select("doc_id", "fingerprint", "component_id").collect()
    assert sorted(map(tuple, got)) == want


def naive_suffixes(t):
    sa = sorted(range(len(t)), key=lambda i: t[i:])
    lcp = [0]
    for a, b in zip(sa, sa[1:]):
        k = 0
        while a + k < len(t) and b + k < len(t) and t[a + k] == t[b + k]:
            k += 1
        lcp.append(k)
    return sa, lcp


@pytest.mark.parametrize("least", [0.5, 1, 100])
def test_induced_sort_equals_naive(monkeypatch, least):
    monkeypatch.setattr(induced_sort, "LEAST_PER_SYMBOL", least)
    rng = np.random.default_rng(7)
    for it in range(400):
        s = int(rng.integers(1, 6))
        t = rng.integers(1, s + 1, int(rng.integers(1, 70)))
        if it % 3 == 0:
            t = np.tile(t[:4], 15)
        t = np.append(t, 0)
        small = [{}, {"queue_bytes": 64, "array_bytes": 16}, {"queue_bytes": 64, "array_bytes": 16, "block": 3}][it // 2 % 3]     # through disk, in blocks
        with induced_sort.Workspace(**small) as work:
            sa, lcp = induced_sort.suffix_array(t, work)
            assert (list(sa), list(lcp)) == naive_suffixes(t.tolist())


def test_induced_sort_of_a_text_ten_times_its_memory():
    import tracemalloc
    memory, n = 1 << 19, 10 << 19
    rng = np.random.default_rng(17)
    words = [rng.integers(3, 29, int(rng.integers(2, 9))) for _ in range(3000)]
    text = np.concatenate([np.append(words[min(int(i), 2999)], 2) for i in rng.pareto(0.8, n // 4) * 3])[:n].astype(np.uint16)
    text[n // 2:n // 2 + 20_000] = text[:20_000]         # a long repeat
    text = np.append(text, 0).astype(np.uint16)
    tracemalloc.start()
    try:
        with induced_sort.Workspace.within(memory) as work:
            sa, lcp = induced_sort.suffix_array(text, work)
            peak = tracemalloc.get_traced_memory()[1]
            sa, lcp = np.array(sa), np.array(lcp)
    finally:
        tracemalloc.stop()
    assert peak < 2 * memory
    assert (np.sort(sa) == np.arange(len(text))).all() and lcp.max() >= 20_000
    for i in rng.integers(1, len(text), 20_000).tolist():        # neighbours differ after their common prefix, in order
        a, b, k = int(sa[i - 1]), int(sa[i]), int(lcp[i])
        assert k == 0 or (text[a:a + k] == text[b:b + k]).all()
        assert text[a + k] < text[b + k]


def slow_removal(texts, length):
    from collections import Counter
    b = [(t or "").encode() for t in texts]
    count = Counter(x[i:i + length] for x in b for i in range(len(x) - length + 1))
    out = []
    for x in b:
        hit = bytearray(len(x))
        for i in range(len(x) - length + 1):
            if count[x[i:i + length]] > 1:
                hit[i:i + length] = b"\1" * length
        out.append((bytes(c for c, f in zip(x, hit) if not f), sum(hit), len([r for r in bytes(hit).split(b"\0") if r])))
    return out


def test_repeats_equal_brute_force(ready):
    rng = np.random.default_rng(11)
    word = lambda n: "".join(rng.choice(list("abcdé "), n))
    passages = [word(60), word(200), "ab" * 40, word(41)]
    texts = ["", None, "short"] + [word(int(rng.integers(0, 300))) for _ in range(40)]
    for _ in range(60):
        texts.append(word(int(rng.integers(0, 90))) + passages[int(rng.integers(0, 4))] + word(int(rng.integers(0, 90))))
    texts += ["z" * 500, "ab" * 300, texts[-1], passages[1] + passages[1]]
    df = ready.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for length in (40, 60):
        got = {r.doc_id: r for r in suffix_dedup.remove_repeats(df, "doc_id", "text", length)
               .withColumn("n", suffix_dedup.removed_bytes(F.col("spans"))).collect()}
        for i, (kept, n, spans) in enumerate(slow_removal(texts, length)):
            assert (bytes(got[i].kept), got[i].n, len(got[i].spans)) == (kept, n, spans), i


def test_repeats_edge_cases(ready, awkward, nothing):
    out = suffix_dedup.remove_repeats(awkward, "doc_id", "text", 400).collect()
    assert len(out) == awkward.count()
    by = {r.doc_id: r for r in out}
    assert by[3].n_bytes == 0 and bytes(by[3].kept) == b"" and not by[1].spans
    assert len(by[7].spans) == 1 and by[7].n_bytes > 400          # repeats itself
    assert suffix_dedup.remove_repeats(nothing, "doc_id", "text", 400).count() == 0


def test_op9_equals_brute_force(ready):
    docs = read(ready, SF_SMALL, "documents").select("doc_id", "text").collect()
    want = {r.doc_id: (len((r.text or "").encode()), n, s, hashlib.sha256(k).hexdigest())
            for r, (k, n, s) in zip(docs, slow_removal([r.text for r in docs], 400))}
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in E.queries()["op9_suffix_dedup"](ready, SF_SMALL).collect()}
    assert got == want and sum(x[1] for x in want.values()) > 0


def slow_links(rows, least):
    v = [embed_dedup.as_vector(x) for _, x in rows]
    pairs = [(i, j) for i in range(len(v)) for j in range(len(v)) if i != j and v[i] is not None and v[j] is not None
             and len(v[i]) == len(v[j])
             and np.dot(v[i], v[j]) / np.linalg.norm(v[i]) / np.linalg.norm(v[j]) >= least]
    return pairs


def test_embedding_join_equals_all_pairs(ready, monkeypatch):
    monkeypatch.setattr(embed_dedup, "CELL_ROWS", 30)       # many cells, and cells of several blocks
    monkeypatch.setattr(embed_dedup, "OWN_BLOCK", 16)
    monkeypatch.setattr(embed_dedup, "MEMBER_BLOCK", 50)
    rng = np.random.default_rng(13)
    centre = rng.normal(size=(12, 8))
    x = np.concatenate([centre[rng.integers(0, 12, 300)] + rng.normal(size=(300, 8)) * 0.35, np.tile(centre[0], (60, 1))])
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(900, None), (901, []), (902, [0.0] * 8), (903, [1.0, None] + [0.0] * 6), (904, [float("nan")] * 8),
             (905, [1.0, 2.0]), (906, [2.0, 4.0]), (907, [float("inf")] * 8)]
    df = ready.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    pairs = slow_links(rows, 0.9)
    comp = components(len(rows), pairs)
    n = np.bincount([a for a, _ in pairs], minlength=len(rows))
    got = embed_dedup.near_duplicates(df, "vec_id", "embedding", 0.9).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == \
        sorted((rows[i][0], int(n[i]), rows[comp[i]][0]) for i in range(len(rows)))
    assert embed_dedup.near_duplicates(df.limit(0), "vec_id", "embedding").count() == 0


def test_embedding_join_copies_no_vector(ready, monkeypatch):
    """Vectors without structure visit every cell; what is written must not grow with the cells."""
    monkeypatch.setattr(embed_dedup, "CELL_ROWS", 40)
    monkeypatch.setattr(embed_dedup, "OWN_BLOCK", 32)
    wrote = {}

    def watched(df, name, saved=embed_dedup.saved):
        out = saved(df, name)
        wrote.setdefault(name, []).append((df._jdf.queryExecution().executedPlan().toString(), out.toPandas()))
        return out

    monkeypatch.setattr(embed_dedup, "saved", watched)
    rng = np.random.default_rng(17)
    x = rng.normal(size=(700, 64))
    x[500:] = x[rng.integers(0, 300, 200)] + rng.normal(size=(200, 64)) * 0.44       # on both sides of the cosine
    x = np.concatenate([x, x[:40]]).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = ready.createDataFrame(rows, "vec_id bigint, embedding array<float>").repartition(4)
    pairs = slow_links(rows, 0.9)
    comp, n = components(len(rows), pairs), np.bincount([a for a, _ in pairs], minlength=len(rows))
    got = embed_dedup.near_duplicates(df, "vec_id", "embedding", 0.9).collect()
    assert sorted(tuple(r) for r in got) == [(i, int(n[i]), comp[i]) for i in range(len(rows))]
    assert 40 < len(pairs) // 2 - 40 < 200
    plan, _ = wrote["vec-links"][0]
    assert "Exchange" not in plan
    assert sum(len(v) for v in wrote["vec-blocks"][0][1]["vec"]) == 700 * 64 * 4


def test_embedding_crowds_and_first_axes(ready, monkeypatch):
    """Tiles full of links, tiles of few, and pairs that only their last axes tell apart."""
    monkeypatch.setattr(embed_dedup, "CELL_ROWS", 150)
    monkeypatch.setattr(embed_dedup, "OWN_BLOCK", 100)
    monkeypatch.setattr(embed_dedup, "MEMBER_BLOCK", 48)
    rng = np.random.default_rng(23)
    x = rng.normal(size=(600, 40)) * 0.9 ** np.arange(40)
    x[:250] = rng.normal(size=40) + rng.normal(size=(250, 40)) * 0.3
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = ready.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(3)
    pairs = slow_links(rows, 0.9)
    comp, n = components(len(rows), pairs), np.bincount([a for a, _ in pairs], minlength=len(rows))
    got = embed_dedup.near_duplicates(df, "vec_id", "embedding", 0.9).collect()
    assert sorted(tuple(r) for r in got) == [(i, int(n[i]), comp[i]) for i in range(len(rows))] and len(pairs) > 10_000


def test_embedding_repeated_and_null_ids(ready):
    rows = [(5, [1.0, 0.0]), (5, [1.0, 0.0]), (None, [1.0, 0.0]), (7, [0.0, 1.0]), (None, None)]
    df = ready.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    got = sorted((r.vec_id or -1, r.n_links, r.component_id or -1) for r in embed_dedup.near_duplicates(df, "vec_id", "embedding").collect())
    assert got == [(-1, 0, -1), (-1, 2, 5), (5, 2, 5), (5, 2, 5), (7, 0, 7)]


def test_pieces_of_copies_are_taken_once(ready, monkeypatch):
    rng = np.random.default_rng(8)
    text = bytes(rng.integers(97, 123, 3000).astype(np.uint8)).decode()
    copies = 3000
    rows = (ready.range(copies).select(F.col("id").alias("doc_id"), F.lit(text).alias("text"))
            .union(ready.createDataFrame([(copies, "x" + text[500:1500] + "y")], "doc_id bigint, text string")))
    tables = []
    keep = suffix_dedup.saved
    monkeypatch.setattr(suffix_dedup, "saved", lambda df, name: tables.append((name, keep(df, name))) or tables[-1][1])
    got = {r.doc_id: r for r in suffix_dedup.remove_repeats(rows, "doc_id", "text").where(f"doc_id in (0, {copies})").collect()}
    assert got[0].kept == b"" and got[copies].kept == b"xy"
    pieces, found = [t for name, t in tables if name == "pieces"]
    assert found.count() < pieces.count() / 10
    row = [(1, b"p", b"d", 7)] * 500 + [(1, b"p", b"d", 9), (1, b"p", b"e", 7)]
    many = ready.createDataFrame(row, "key bigint, piece binary, digest binary, lo bigint")
    marked = ready.createDataFrame([(1, b"p", [(0, 3)])], "key bigint, piece binary, runs array<struct<a:bigint,b:bigint>>")
    lists = {bytes(r.digest): sorted((x.a, x.b) for x in r.runs) for r in suffix_dedup._starts(many, marked, 400).collect()}
    assert lists == {b"d": [(7, 409), (9, 411)], b"e": [(7, 409)]}


@pytest.mark.parametrize("limit", [1, 3000])
def test_wide_keys_are_parted_by_whole_windows(ready, monkeypatch, limit):
    monkeypatch.setattr(suffix_dedup, "WIDE_BYTES", limit)
    rng = np.random.default_rng(21)
    word = lambda n: "".join(rng.choice(list("abcdé "), n))
    passage = word(50)              # one key in very many contexts, some of them twice
    ends = [word(30) for _ in range(25)]
    texts = [word(int(rng.integers(0, 40))) + passage + ends[int(rng.integers(0, 25))] for _ in range(60)] + [passage * 3, None]
    texts += texts[:2]
    df = ready.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r for r in suffix_dedup.remove_repeats(df, "doc_id", "text", 60)
           .withColumn("n", suffix_dedup.removed_bytes(F.col("spans"))).collect()}
    for i, (kept, n, spans) in enumerate(slow_removal(texts, 60)):
        assert (bytes(got[i].kept), got[i].n, len(got[i].spans)) == (kept, n, spans), i
