"""SimHash near-duplicates by a byte-position inverted index.

A 64-bit fingerprint is eight positional bytes.  Two fingerprints that
differ in at most three bits differ in at most three bytes, so they share at
least five positional bytes: five is the guaranteed minimum of the count
filter.  Postings under single bytes would hold 1/256 of all fingerprints
each and their tallies would grow with the square of the input; the index
therefore keeps postings under every choice of five positions with their
bytes (56 a fingerprint), which is where a pair's tally reaches the minimum.
Inside a posting the shared bytes of each pair are tallied, pairs at the
minimum are verified by their bit distance, and a pair found under several
keys is reported under its first only.

A posting of many fingerprints (a crowd of near copies) does not compare its
pairs: its members differ in three bytes only, so the neighbours of each are
looked up by flipping up to ``max_bits`` of those 24 bits, and a spanning
forest of the links found is reported - linear in the members, and no
connection is lost.

Fingerprints, not documents, are linked: copies share one.

Edge cases: a null text and one without words have fingerprint zero; texts
shorter than a shingle hash their whole word sequence; repeated rows share a
fingerprint; rows with a null id get the component of their fingerprint,
whose id is the smallest non-null one (null if none); an empty table gives an
empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rungkit.llm.common import keyed, saved, worker_memo
from rungkit.llm.components import connected_components

SEED = 42
SPLIT_PAIRS = 64       # a posting beyond this size is linked by bit flips
_STEP = 1 << 16        # shingles whose bits are counted at once


def _fingerprint(text: str | None, width: int) -> int:
    import xxhash
    words = text.encode().lower().split() if text else []
    n = len(words) - width + 1
    if not words:
        return 0
    if n <= 1:
        shingles = iter([b" ".join(words)])
    else:
        shingles = map(b" ".join, zip(*[words[i:] for i in range(width)]))
    n = max(n, 1)
    ones = np.zeros(64, dtype=np.int64)
    hash64 = xxhash.xxh64_intdigest
    for at in range(0, n, _STEP):
        m = min(_STEP, n - at)
        h = np.fromiter((hash64(s, SEED) for s, _ in zip(shingles, range(m))), dtype="<u8", count=m)
        ones += np.unpackbits(h.view(np.uint8).reshape(m, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def fingerprints(df: DataFrame, id_col: str, text_col: str, shingle: int = 3) -> DataFrame:
    """One row per input row: ``id_col``, ``text_hash``, ``fp`` (bigint holding
    the 64 bits)."""

    @F.pandas_udf("bigint")
    def fp(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        worker_memo(None)
        for s in batches:
            yield pd.Series([_fingerprint(t, shingle) for t in s], dtype="int64")

    return keyed(df, id_col, text_col).select(F.col("c0").alias(id_col), F.xxhash64("c1").alias("text_hash"),
                                              fp("c1").alias("fp"))


class _Linker:
    """Links inside postings: rows (key number, key value, fingerprint)."""

    def __init__(self, max_bits: int, shared: int):
        self.max_bits, self.shared = max_bits, shared
        self.choices = list(combinations(range(8), shared))
        first = np.full(256, -1, dtype=np.int64)   # by the set of equal bytes: the first choice inside it
        for equal in range(256):
            for k, c in enumerate(self.choices):
                if all(equal >> p & 1 for p in c):
                    first[equal] = k
                    break
        self.first = first
        flips = [0]
        free = 8 * (8 - shared)
        for r in range(1, max_bits + 1):
            flips += [sum(1 << b for b in bits) for bits in combinations(range(free), r)]
        self.flips = np.array(flips[1:], dtype=np.int64)
        self.there = None

    def pairs(self, choice: np.ndarray, group: np.ndarray, fp: np.ndarray):
        """Verified links between rows of the same small group (rows sorted by group)."""
        size = int(np.bincount(group - group[0]).max()) if len(group) else 0
        for s in range(1, size):
            same = group[s:] == group[:-s]
            a, b, c = fp[:-s][same], fp[s:][same], choice[s:][same]
            x = a ^ b
            equal = np.zeros(len(x), dtype=np.int64)
            tally = np.zeros(len(x), dtype=np.int64)
            for p in range(8):
                hit = (x >> (8 * p) & 0xFF) == 0
                tally += hit
                equal |= hit.astype(np.int64) << p
            keep = (tally >= self.shared) & (np.bitwise_count(x.view(np.uint64)) <= self.max_bits)
            keep &= self.first[equal] == c
            yield a[keep], b[keep]

    def forest(self, choice: int, fp: np.ndarray):
        """A spanning forest of the links inside one large posting."""
        free = [p for p in range(8) if p not in self.choices[choice]]
        small = np.zeros(len(fp), dtype=np.int64)
        for k, p in enumerate(free):
            small |= (fp >> (8 * p) & 0xFF) << (8 * k)
        order = np.argsort(small)
        small, fp = small[order], fp[order]
        if self.there is None:
            self.there = np.zeros(1 << (8 * len(free)), dtype=bool)
        there = self.there
        there[small] = True
        for start in small:
            if not there[start]:
                continue
            there[start] = False
            front = np.array([start])
            while len(front):
                grown = []
                for at in range(0, len(front), 256):
                    part = front[at:at + 256]
                    near = part[:, None] ^ self.flips[None, :]
                    row, col = np.nonzero(there[near])
                    if len(row):
                        new, where = np.unique(near[row, col], return_index=True)
                        there[new] = False
                        grown.append(new)
                        a = fp[np.searchsorted(small, part[row[where]])]
                        yield a, fp[np.searchsorted(small, new)]
                front = np.concatenate(grown) if grown else front[:0]


def fingerprint_links(fps: DataFrame, max_bits: int = 3) -> DataFrame:
    """``fps``: distinct fingerprints (column fp).  Returns links ``u``, ``v``:
    every pair within ``max_bits`` bits, except inside crowded postings, where
    a spanning forest stands for the pairs."""
    if not 0 <= max_bits <= 3:
        raise ValueError("the positional index covers 0 to 3 differing bits")
    shared = 8 - 3
    masks = [sum(0xFF << (8 * p) for p in c) for c in combinations(range(8), shared)]
    masks = [m - (1 << 64) if m >= 1 << 63 else m for m in masks]
    postings = (fps.where("fp is not null")
                .select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])))
                .select(F.col("pos").alias("choice"), F.col("col").alias("key"), "fp"))

    def link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        linker, rest = _Linker(max_bits, shared), None
        for pdf in _whole_postings(batches):
            del rest
            choice = pdf["choice"].to_numpy(np.int64)
            key, fp = pdf["key"].to_numpy(np.int64), pdf["fp"].to_numpy(np.int64)
            new = np.ones(len(fp), dtype=bool)
            new[1:] = (choice[1:] != choice[:-1]) | (key[1:] != key[:-1])
            start = np.flatnonzero(new)
            size = np.diff(np.append(start, len(fp)))
            group = np.repeat(np.arange(len(start)), size)
            own = size[group]
            few = (own > 1) & (own <= SPLIT_PAIRS)
            for a, b in linker.pairs(choice[few], group[few], fp[few]):
                if len(a):
                    yield pd.DataFrame({"u": a, "v": b})
            for g in np.flatnonzero(size > SPLIT_PAIRS):
                i = start[g]
                for a, b in linker.forest(int(choice[i]), fp[i:i + size[g]]):
                    yield pd.DataFrame({"u": a, "v": b})
            rest = None

    return (postings.repartition("choice", "key").sortWithinPartitions("choice", "key")
            .mapInPandas(link, "u bigint, v bigint"))


def _whole_postings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Regroup sorted batches so that no posting is cut; a posting's size is
    bounded by the 2**24 values of its free bytes."""
    held: list[pd.DataFrame] = []
    for pdf in batches:
        if not len(pdf):
            continue
        c, k = pdf["choice"].to_numpy(), pdf["key"].to_numpy()
        last = int(np.flatnonzero((c != c[-1]) | (k != k[-1]))[-1]) + 1 if (c[0], k[0]) != (c[-1], k[-1]) else 0
        if last:
            yield pd.concat([*held, pdf.iloc[:last]]) if held else pdf.iloc[:last]
            held = [pdf.iloc[last:]]
        elif held and (held[-1]["choice"].iloc[-1], held[-1]["key"].iloc[-1]) != (c[0], k[0]):
            yield pd.concat(held)
            held = [pdf]
        else:
            held.append(pdf)
    if held:
        yield pd.concat(held)


def near_duplicates(df: DataFrame, id_col: str, text_col: str, shingle: int = 3, max_bits: int = 3) -> DataFrame:
    """One row per input row: ``id_col``, ``text_hash``, ``fp``, ``group`` (a
    number of the component) and ``component_id`` (smallest id reachable over
    links between fingerprints)."""
    rows = saved(fingerprints(df, id_col, text_col, shingle).withColumnRenamed(id_col, "c0"), "simhash")
    fps = saved(rows.groupBy("fp").agg(F.min("c0").alias("least")), "simhash-fp")
    linked = connected_components(fingerprint_links(fps, max_bits))
    member = (fps.join(linked, F.col("fp") == F.col("node"), "left")
              .select("fp", "least", F.coalesce("component", "fp").alias("component")))
    least = member.groupBy("component").agg(F.min("least").alias("component_id"))
    classes = member.join(least, "component").select("fp", F.col("component").alias("group"), "component_id")
    return rows.join(classes, "fp").select(F.col("c0").alias(id_col), "text_hash", "fp", "group", "component_id")
