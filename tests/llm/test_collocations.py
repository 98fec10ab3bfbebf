import random
import re
from collections import Counter

import numpy as np
import pytest

from rungkit.llm import collocations as co


def brute(rows, least, most, top):
    """rows: (text, lang).  What the query returns, by plain counting."""
    total, f = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = [x for x in re.split("[ \t]+", piece) if x]
            total[lang] += len(w)
            for m in range(1, most + 1):
                for i in range(len(w) - m + 1):
                    f[lang, tuple(w[i:i + m])] += 1
    f = {k: a for k, a in f.items() if a >= least}
    found = {}
    for (lang, ws), a in f.items():
        if len(ws) < 2:
            continue
        if any(g == lang and len(v) > len(ws) and 100 * b >= 100 * a and any(v[i:i + len(ws)] == ws for i in range(len(v)))
               for (g, v), b in f.items()):
            continue
        s, k = min((1000 * a * total[lang] // (f[lang, ws[:k]] * f[lang, ws[k:]]), k) for k in range(1, len(ws)))
        found.setdefault(lang, []).append((-s, -a, " ".join(ws).encode(), f[lang, ws[:k]], f[lang, ws[k:]]))
    return sorted((lang, i + 1, p.decode(), -a, l, r, total[lang], -s) for lang, x in found.items()
                  for i, (s, a, p, l, r) in enumerate(sorted(x)[:top]))


def run(df, least, most, top):
    out = co.first_of_each(co.collocations(df, "text", "lang", least, most), top)
    return sorted(tuple(r) for r in out.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def test_packing():
    x = np.random.default_rng(0).integers(-1, 2 ** 31, 1000)
    assert (co.unpack(co.pack(x)) == x).all() and len(co.unpack(co.pack(x[:0]))) == 0
    x = np.unique(x[x >= 0])
    assert (co.unpack_cells(co.pack_cells(x)) == x).all()


@pytest.mark.parametrize("dense", [1, 300, 10 ** 9])
def test_tiles_count_every_pair(monkeypatch, dense):
    monkeypatch.setattr(co, "DENSE", dense)
    rng = np.random.default_rng(1)
    a = np.concatenate([rng.integers(0, 60, 3000), rng.integers(0, 9000, 2000)])
    b = np.concatenate([rng.integers(0, 60, 3000), rng.integers(0, 9000, 2000)])
    want = Counter(zip(a.tolist(), b.tolist()))
    got, sums = Counter(), {}
    for half in (slice(0, 2500), slice(2500, None)):
        for r, c, cells, counts in co.tile_counts(a[half], b[half]):
            assert (np.diff(cells) > 0).all() and cells.max() < co.TILE ** 2
            sums.setdefault((r, c), co.TileSum()).add(cells, counts)
    for (r, c), s in sums.items():
        for cell, n in zip(*map(np.ndarray.tolist, s.result())):
            got[r * co.TILE + cell // co.TILE, c * co.TILE + cell % co.TILE] += n
    assert got == want


def corpus(seed, n, words):
    rng = random.Random(seed)
    vocab = [f"w{i}" if i % 7 else f"É{i}" for i in range(words)]
    stock = [[rng.choice(vocab) for _ in range(rng.randint(2, 7))] for _ in range(words // 3)]
    rows = []
    for _ in range(n):
        w = []
        for _ in range(rng.randint(0, 30)):
            w += rng.choice(stock) if rng.random() < 0.6 else [vocab[min(int(rng.paretovariate(0.6)), words) - 1]]
            if rng.random() < 0.2:
                w[-1] += rng.choice([".", ",", " ;", "\n", "\r\n", "!?", "\t", "  ", "\x0b", "\x0c"])
        rows.append((" ".join(w).title() if rng.random() < 0.2 else " ".join(w), rng.choice(["en", "en", "de", None])))
    return rows


@pytest.mark.parametrize("seed,n,words,least,head", [(1, 300, 40, 5, None), (2, 600, 5000, 2, None), (3, 300, 60, 4, 25)])
def test_equals_brute_force(ready, monkeypatch, seed, n, words, least, head):
    if head:                                # the rest of the words by a join, and many small chunks
        monkeypatch.setattr(co, "HEAD_WORDS", head)
        monkeypatch.setattr(co, "CHUNK_WORDS", 50)
        monkeypatch.setattr(co, "HELD_WORDS", 30)
    rows = corpus(seed, n, words)
    df = ready.createDataFrame(rows, "text string, lang string").repartition(6)
    assert run(df, least, 5, 2000) == brute(rows, least, 5, 2000)


def test_chunk_of_few_words_beyond_the_head(ready, monkeypatch):
    """A chunk's known ids may exceed the number of its other words."""
    monkeypatch.setattr(co, "HEAD_WORDS", 40)
    common = " ".join(f"h{i}" for i in range(40))
    rows = [(f"{common} rare{i % 3} {common}. once{i}", "en") for i in range(9)] + [(common, "de")]
    df = ready.createDataFrame(rows, "text string, lang string").repartition(9)
    assert run(df, 3, 5, 2000) == brute(rows, 3, 5, 2000)


def test_long_texts_are_cut_at_piece_ends():
    text = co._END.join(b"a b c" for _ in range(3 * co.PART_BYTES // 6)) + b" " + b"x" * (2 * co.PART_BYTES)
    parts = list(co._parts(text))
    assert len(parts) > 1 and co._END.join(parts) == text


def test_scores_beyond_64_bits(ready):
    df = ready.createDataFrame([("a b " * 200_000, "x"), ("c d", "x")], "text string, lang string")
    got = run(df, 1, 2, 10)
    n, a = 400_002, 200_000
    assert ("x", 1, "c d", 1, 1, 1, n, 1000 * n) in got and ("x", 2, "a b", a, a, a, n, 1000 * a * n // a ** 2) in got
    big = ready.sql("select cast(9e15 as bigint) a, cast(9e18 as bigint) n, cast(9e15 as bigint) l, cast(9e17 as bigint) r").selectExpr(
        "cast(cast(1000 as decimal(38,0)) * cast(a as decimal(38,0)) as decimal(38,0)) * cast(n as decimal(38,0)) div "
        "cast(cast(l as decimal(38,0)) * cast(r as decimal(38,0)) as decimal(38,0)) as s").first().s
    assert big == 1000 * 9 * 10 ** 18 // (9 * 10 ** 17)


def test_awkward_rows(ready, awkward, nothing):
    rows = [(r.text, r.lang) for r in awkward.collect()]
    assert run(awkward, 2, 5, 50) == brute(rows, 2, 5, 50)
    assert run(nothing, 1, 5, 50) == []
