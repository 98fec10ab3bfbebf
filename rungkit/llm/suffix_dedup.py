"""Exact repeated strings by suffix arrays over shards.

Every string of ``length`` bytes that starts at two places of the corpus is a
pair of neighbours in suffix order with a common prefix of at least
``length``.  The corpus is cut into shards that keep such strings together:
the smallest hash among the GRAM-byte substrings of a window of ``length``
bytes depends on the window's content alone, so equal windows carry equal
keys.  Consecutive windows with one key form a piece (their bytes, about
``length`` plus some hundred).  A key that occurs in one piece only cannot
have a second window, unless its place moves inside the piece; all pieces of
the other keys go to the shard of their key, equal pieces as one with a count,
and each shard's suffixes are sorted by external induced sorting
(:mod:`rungkit.llm.induced_sort`), whose common-prefix values mark the windows.

Shards are cut by size at key boundaries.  A key with more is one shard, which
the sort takes in bounded memory (its pieces are held, everything else is in
disk-backed arrays).  A key beyond WIDE_BYTES (a passage in very many contexts)
is parted: each of its windows is keyed by the hash of its whole content, keys
that stand at one place only go, and the windows left are sorted as pieces of
their own.  So no shard grows with the input.

Rows are handled by the digest of their text.  A text that occurs twice goes
whole, since its copies are each other's second place; to other texts all its
copies are one place.

Edge cases: a null text is empty; texts shorter than ``length`` lose nothing;
strings overlap freely and are judged on the input; windows never cross
texts; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rungkit.llm.common import keyed, saved, worker_memo
from rungkit.llm.induced_sort import Workspace, suffix_array

GRAM = 128                # bytes hashed at once; at most the length
PIECE_WINDOWS = 4096      # windows of a piece at most
BATCH_BYTES = 1 << 18     # bytes hashed together
SHARD_BYTES = 5 << 18     # bytes sorted together, as far as keys allow
WIDE_BYTES = 24 << 20     # bytes of a key from which it is parted by whole windows
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_powers: dict[int, tuple] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the (odd) base modulo 2**64, and of its inverse."""
    if not _powers or len(_powers[0][0]) < n:
        with np.errstate(over="ignore"):
            inv = np.uint64(pow(int(_BASE), -1, 1 << 64))
            up = np.cumprod(np.full(n, _BASE, dtype=np.uint64))
            down = np.cumprod(np.full(n, inv, dtype=np.uint64))
        _powers[0] = up, down
    return _powers[0][0][:n], _powers[0][1][:n]


def gram_hashes(b: np.ndarray, gram: int) -> np.ndarray:
    """64-bit hash of each ``gram``-byte substring."""
    up, down = _power_tables(max(len(b), BATCH_BYTES))
    with np.errstate(over="ignore"):
        total = np.zeros(len(b) + 1, dtype=np.uint64)
        np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[:len(b)], out=total[1:])
        h = (total[gram:] - total[:-gram]) * down[:len(b) - gram + 1]
        h ^= h >> np.uint64(31)
        h *= _MIX
        h ^= h >> np.uint64(29)
        h *= _BASE
        h ^= h >> np.uint64(32)
    return h


def _window_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each run of ``w`` values."""
    size = 1
    while size * 2 <= w:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    rest = w - size
    return np.minimum(x[:len(x) - rest], x[rest:]) if rest else x


def _pieces(texts: list[bytes], length: int, gram: int):
    """(text number, first window, last window, key, place moves) of all pieces
    (with ``gram`` equal to ``length`` every window is one)."""
    w = length - gram + 1
    n_bits = np.uint64(BATCH_BYTES.bit_length() + 1)
    run, size = [], 0
    out = []

    def flush():
        sizes = np.array([len(x[2]) for x in run])
        b = np.frombuffer(b"".join(x[2] for x in run), dtype=np.uint8)
        start = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        h = gram_hashes(b, gram)
        packed = (h >> n_bits << n_bits) | np.arange(len(h), dtype=np.uint64)
        place = (_window_min(packed, w) & ((np.uint64(1) << n_bits) - np.uint64(1))).astype(np.int64)
        # windows that lie inside one text, in a row
        inside = sizes - length + 1
        win = np.arange(inside.sum()) + np.repeat(start - (np.cumsum(inside) - inside), inside)
        who = np.repeat(np.arange(len(run)), inside)
        place = place[win]
        key = h[place]
        at = win - start[who]
        cut = np.ones(len(win), dtype=bool)
        cut[1:] = (who[1:] != who[:-1]) | (key[1:] != key[:-1])
        first = np.flatnonzero(cut)
        group = np.cumsum(cut) - 1
        cut |= (np.arange(len(win)) - first[group]) % PIECE_WINDOWS == 0
        first = np.flatnonzero(cut)
        last = np.append(first[1:], len(win)) - 1
        number = np.array([x[0] for x in run])[who[first]]
        base = np.array([x[1] for x in run])[who[first]]
        out.append((number, base + at[first], base + at[last], key[first].view(np.int64),
                    place[first] != place[last]))

    for i, t in enumerate(texts):
        for lo in range(0, max(len(t) - length + 1, 0), BATCH_BYTES // 2):
            part = t[lo:lo + BATCH_BYTES // 2 + length - 1]
            if run and size + len(part) > BATCH_BYTES:
                flush()
                run, size = [], 0
            run.append((i, lo, part))
            size += len(part)
    if run:
        flush()
    return [np.concatenate(x) for x in zip(*out)] if out else None


def repeated_windows(pieces: list[bytes], windows: list[int], twice: list[bool], length: int,
                     work: Workspace | None = None) -> list[np.ndarray]:
    """For each of the distinct ``pieces``, which of its first ``windows``
    starts begin a string of ``length`` bytes that starts elsewhere too.
    ``twice``: the piece itself occurs more than once."""
    sizes = np.array([len(p) + 1 for p in pieces])
    start = np.cumsum(sizes) - sizes
    n = int(sizes.sum()) + 1
    with work or Workspace() as work:
        text, marked, counted = work.array(n, np.uint16), work.array(n, bool), work.array(n, bool)
        for s, p, k, more in zip(start.tolist(), pieces, windows, twice):
            b = np.frombuffer(p, dtype=np.uint8)
            text[s:s + len(b)] = b
            text[s:s + len(b)] += 2
            text[s + len(b)] = 1               # between pieces
            counted[s:s + k] = True
            if more:
                marked[s:s + k] = True
        text[n - 1] = 0
        order, common = suffix_array(text, work)
        # windows of pieces, in suffix order; a place that is no window of its
        # own piece repeats one that is, so it stands between without harm
        last, least = None, 0
        for lo, hi in work.blocks(n):
            places, near = np.array(order[lo:hi]), np.array(common[lo:hi])
            spot = np.flatnonzero(counted[places])
            if not len(spot):
                least = min(least, int(near.min()))
                continue
            between = np.minimum.reduceat(near[:spot[-1] + 1], np.append(0, spot[:-1] + 1))
            places = places[spot]
            between[0] = min(int(between[0]), least) if last is not None else 0
            before = np.append(places[0] if last is None else last, places[:-1])
            hit = between >= length
            marked[places[hit]] = True
            marked[before[hit]] = True
            last, least = places[-1], int(near[spot[-1] + 1:].min()) if spot[-1] + 1 < len(near) else 1 << 30
        return [np.array(marked[s:s + k]) for s, k in zip(start.tolist(), windows)]


def _runs(flag: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flag.view(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


def _keyed_pieces(texts: DataFrame, length: int, gram: int) -> DataFrame:
    """digest, d1, d2 (the digest's two halves), lo, hi, key, moves."""
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        worker_memo(None)
        for pdf in batches:
            got = _pieces([t.encode() for t in pdf["text"]], length, gram)
            if got is not None:
                number, lo, hi, key, moves = got
                digest = pdf["digest"].to_numpy()
                half = np.frombuffer(b"".join(digest), "<i8").reshape(-1, 2)
                for s in range(0, len(number), 100_000):
                    e = slice(s, s + 100_000)
                    n = number[e]
                    yield pd.DataFrame({"digest": digest[n], "d1": half[n, 0], "d2": half[n, 1], "lo": lo[e], "hi": hi[e],
                                        "key": key[e], "moves": moves[e]})

    return saved(texts.mapInPandas(cut, "digest binary, d1 bigint, d2 bigint, lo bigint, hi bigint, key bigint, moves boolean"), "pieces")


def _shared_keys(pieces: DataFrame) -> DataFrame:
    """Keys that stand at two places of different texts or of one text (copies
    of a text are one), or whose place moves within a piece."""
    ends = [f(c).alias(f"{name}_{c}") for c in ("d1", "d2", "lo") for f, name in ((F.min, "least"), (F.max, "most"))]
    differ = " or ".join(f"least_{c} <> most_{c}" for c in ("d1", "d2", "lo"))
    return pieces.groupBy("key").agg(*ends, F.max("moves").alias("moves")).where(f"moves or {differ}").select("key")


def _extracted(texts: DataFrame, pieces: DataFrame, length: int) -> DataFrame:
    """key, piece (digest of its bytes), digest, lo, bytes of ``pieces``, those
    of a text's copies once."""
    # of one text, a list no longer than the text
    wanted = (pieces.select("digest", "lo", "hi", "key").distinct()
              .groupBy("digest").agg(F.collect_list(F.struct("lo", "hi", "key")).alias("want")))

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        worker_memo(None)
        names, last = ["key", "piece", "digest", "lo", "bytes"], None
        for pdf in batches:
            rows, size = [], 0
            for digest, text, want in zip(pdf["digest"], pdf["text"], pdf["want"]):
                if digest == last:                  # the join puts copies in a row
                    continue
                last, b = digest, text.encode()
                for x in want:
                    piece = b[x["lo"]:x["hi"] + length]
                    rows.append((x["key"], hashlib.blake2b(piece, digest_size=16).digest(), digest, x["lo"], piece))
                    size += len(piece)
                    if size > 4 << 20:
                        yield pd.DataFrame(rows, columns=names)
                        rows, size = [], 0
            if rows:
                yield pd.DataFrame(rows, columns=names)

    return saved(texts.join(wanted, "digest").select("digest", "text", "want")
                 .mapInPandas(extract, "key bigint, piece binary, digest binary, lo bigint, bytes binary"), "pieces")


def repeated_spans(texts: DataFrame, length: int) -> DataFrame:
    """``texts``: digest, text.  Returns ``digest``, ``spans`` (start and end
    byte of the maximal runs covered by repeated strings) where there are any."""
    gram = min(GRAM, length)
    long = texts.where(F.octet_length("text") >= length)
    # the whole of a text that occurs twice is repeated; to other texts its copies are one place more
    copied = saved(long.groupBy("digest").agg(F.count("*").alias("n"), F.max(F.octet_length("text")).alias("size"))
                   .where("n > 1").select("digest", F.array(F.struct(F.lit(0).cast("bigint").alias("a"), F.col("size").cast("bigint").alias("b")))
                                          .alias("spans")), "copied")
    pieces = _keyed_pieces(long, length, gram)
    found = _extracted(long, pieces.join(_shared_keys(pieces), "key", "left_semi"), length)
    distinct = found.groupBy("key", "piece", "bytes").agg(F.count("*").alias("n"))
    sizes = found.groupBy("key", "piece").agg(F.max(F.octet_length("bytes")).alias("size"))
    wide = saved(sizes.groupBy("key").agg(F.sum("size").alias("size")).where(F.col("size") > WIDE_BYTES).select("key"), "wide-keys")
    marked = _marked(distinct.join(wide, "key", "left_anti"), length)
    if wide.limit(1).count():
        marked = marked.unionByName(_marked_windows(saved(distinct.join(wide, "key", "left_semi"), "wide-pieces"), length))
    runs = _starts(found, marked, length)

    @F.pandas_udf("array<struct<a:bigint,b:bigint>>")
    def merge(s: pd.Series) -> pd.Series:
        return pd.Series([_merge([(x["a"], x["b"]) for x in runs]) for runs in s], dtype=object)

    return (runs.join(copied.select("digest"), "digest", "left_anti").select("digest", merge("runs").alias("spans"))
            .unionByName(copied))


def _marked_windows(distinct: DataFrame, length: int) -> DataFrame:
    """key, piece, runs of the ``distinct`` pieces of keys that are no shard:
    each window gets a key of its own, the hash of its whole content, and those
    whose key stands twice are sorted as pieces."""
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            half = np.frombuffer(b"".join(pdf["piece"]), "<i8").reshape(-1, 2)
            for i, (key, piece, b, n) in enumerate(zip(pdf["key"], pdf["piece"], pdf["bytes"], pdf["n"])):
                own = gram_hashes(np.frombuffer(b, np.uint8), length).view(np.int64)
                yield pd.DataFrame({"key": own, "d1": half[i, 0], "d2": half[i, 1], "lo": np.arange(len(own)), "moves": n > 1,
                                    "of": key, "piece": [piece] * len(own)})

    windows = saved(distinct.mapInPandas(cut, "key bigint, d1 bigint, d2 bigint, lo bigint, moves boolean, of bigint, piece binary"), "windows")
    twice = windows.join(_shared_keys(windows), "key", "left_semi")
    own = twice.groupBy("of", "piece").agg(F.collect_list(F.struct("lo", "key")).alias("want"))        # a piece's windows

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for of, piece, b, n, want in zip(pdf["key"], pdf["piece"], pdf["bytes"], pdf["n"], pdf["want"]):
                part = [b[x["lo"]:x["lo"] + length] for x in want]
                yield pd.DataFrame({"key": [x["key"] for x in want], "piece": [hashlib.blake2b(p, digest_size=16).digest() for p in part],
                                    "bytes": part, "n": n, "of": of, "whole": [piece] * len(part), "lo": [x["lo"] for x in want]})

    found = saved(distinct.join(own.withColumnRenamed("of", "key"), ["key", "piece"])
                  .mapInPandas(extract, "key bigint, piece binary, bytes binary, n bigint, of bigint, whole binary, lo bigint"), "window-pieces")
    marked = _marked(found.groupBy("key", "piece", "bytes").agg(F.sum("n").alias("n")), length).select("key", "piece")
    return (found.select("key", "piece", "of", "whole", "lo").join(marked, ["key", "piece"])
            .groupBy(F.col("of").alias("key"), F.col("whole").alias("piece"))
            .agg(F.collect_list(F.struct(F.col("lo").alias("a"), (F.col("lo") + 1).alias("b"))).alias("runs")))


def _marked(distinct: DataFrame, length: int) -> DataFrame:
    """key, piece, runs of window starts that begin repeated strings."""
    def sort(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        worker_memo(None)
        for pdf in _shards(batches):
            got = repeated_windows(pdf["bytes"].tolist(), [len(x) - length + 1 for x in pdf["bytes"]],
                                   (pdf["n"] > 1).tolist(), length)
            runs = [[{"a": a, "b": b} for a, b in _runs(f)] for f in got]
            out = pd.DataFrame({"key": pdf["key"].to_numpy(), "piece": pdf["piece"].to_numpy(), "runs": runs})
            yield out[[bool(r) for r in runs]]

    return (distinct.repartition("key").sortWithinPartitions("key", "piece")
            .mapInPandas(sort, "key bigint, piece binary, runs array<struct<a:bigint,b:bigint>>"))


def _starts(found: DataFrame, marked: DataFrame, length: int) -> DataFrame:
    """``digest``, ``runs``: the marked runs of all pieces of a text, those of
    its copies once (no longer a list than the text has pieces)."""
    return (found.select("key", "piece", "digest", "lo").distinct().join(marked, ["key", "piece"])
            .select("digest", F.transform("runs", lambda r: F.struct(
                (F.col("lo") + r["a"]).alias("a"), (F.col("lo") + r["b"] - 1 + F.lit(length)).alias("b"))).alias("runs"))
            .groupBy("digest").agg(F.flatten(F.collect_list("runs")).alias("runs")))


def _merge(runs: list[tuple[int, int]]) -> list[dict]:
    out: list[list[int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [{"a": a, "b": b} for a, b in out]


def _shards(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted batches regrouped into shards of whole keys."""
    held: list[pd.DataFrame] = []
    size = 0
    for pdf in batches:
        key = pdf["key"].to_numpy()
        sizes = pdf["bytes"].map(len).to_numpy()
        begin = 0
        for i in range(len(pdf)):
            if size >= SHARD_BYTES and (key[i] != key[i - 1] if i else held[-1]["key"].iloc[-1] != key[0]):
                held.append(pdf.iloc[begin:i])
                yield pd.concat([h for h in held if len(h)])
                held, size, begin = [], 0, i
            size += sizes[i]
        if begin < len(pdf):
            held.append(pdf.iloc[begin:])
    if held:
        yield pd.concat(held)


def text_digest(text: Column) -> Column:
    """128 bits of SHA-256."""
    return F.unhex(F.substring(F.sha2(text, 256), 1, 32))


def remove_repeats(df: DataFrame, id_col: str, text_col: str, length: int = 400) -> DataFrame:
    """One row per input row: ``id_col``, ``digest``, ``n_bytes``, ``spans``
    (removed runs, start and end byte) and ``kept`` (the bytes left)."""
    rows = keyed(df, id_col, text_col).select("c0", F.coalesce("c1", F.lit("")).alias("text"))
    rows = rows.withColumn("digest", text_digest(F.col("text")))
    # texts that occur twice are counted once each in the search and are all
    # repeated: every one of their strings starts in the other copy
    spans = saved(repeated_spans(rows.select("digest", "text"), length), "spans")

    @F.pandas_udf("binary")
    def keep(text: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([t.encode() if runs is None else cut_out(t.encode(), runs)
                          for t, runs in zip(text, spans)], dtype=object)

    none = F.array().cast("array<struct<a:bigint,b:bigint>>")
    return (rows.join(spans, "digest", "left")
            .select(F.col("c0").alias(id_col), "digest", F.octet_length("text").cast("bigint").alias("n_bytes"),
                    F.coalesce("spans", none).alias("spans"), keep("text", "spans").alias("kept")))


def rewrite(df: DataFrame, text_col: str, length: int = 400) -> DataFrame:
    """``df`` with repeated strings cut out of ``text_col``; characters of
    which only some bytes are left go whole.  Null texts stay null; all other
    columns and all rows stay."""
    key = "__repeat_digest"
    rows = df.withColumn(key, text_digest(F.coalesce(F.col(text_col), F.lit(""))))
    spans = saved(repeated_spans(rows.select(F.col(key).alias("digest"), F.coalesce(F.col(text_col), F.lit("")).alias("text")),
                                 length), "spans")
    spans = spans.select(F.col("digest").alias(key), F.col("spans").alias("__repeat_spans"))

    @F.pandas_udf("string")
    def keep(text: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else t if runs is None else cut_out(t.encode(), runs).decode("utf-8", "ignore")
                          for t, runs in zip(text, spans)], dtype=object)

    return (rows.join(spans, key, "left").withColumn(text_col, keep(F.col(text_col), F.col("__repeat_spans")))
            .drop(key, "__repeat_spans"))


def cut_out(b: bytes, runs) -> bytes:
    at, parts = 0, []
    for x in runs:
        parts.append(b[at:x["a"]])
        at = x["b"]
    return b"".join([*parts, b[at:]])


def removed_bytes(spans: Column) -> Column:
    return F.aggregate(spans, F.lit(0).cast("bigint"), lambda s, x: s + x["b"] - x["a"])
