"""Byte-level BPE: two-tier encoding and decoding.

Tier one is a minimal perfect hash over the vocabulary (hash and displace:
one displacement per bucket of keys, no empty slot): a whole pre-token that
is in the vocabulary costs one probe.  Tier two takes the misses: a heap of
mergeable neighbour pairs over a linked list of byte runs, lowest rank first
and leftmost on ties, every pair's rank again from the perfect hash.

Texts are cut at single spaces between two non-space characters.  The
pre-token pattern always starts a new match there, so a chunk's tokens do
not depend on what stands around it, and each distinct chunk of a batch is
encoded once.  Chunks already seen by a worker are kept in a bounded memo.

Ids are packed as little-endian unsigned 32-bit integers (one binary value
per text); :func:`unpack_ids` gives an ``array<bigint>``.

Edge cases: a null text is the empty text (no ids, empty bytes); repeated
rows give repeated results; an empty table gives an empty table; texts of
any length are encoded whole.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rungkit.llm.common import keyed, worker_memo

_MASK = (1 << 64) - 1
_MUL = 0x9E3779B97F4A7C15
MEMO_ENTRIES = 400_000


class PerfectHash:
    """Minimal perfect hash of a fixed set of byte strings onto 0..n-1."""

    def __init__(self, keys: list[bytes], keys_per_bucket: int = 3):
        import xxhash
        self.n = len(keys)
        self.n_buckets = max(1, self.n // keys_per_bucket)
        hashes = [xxhash.xxh64_intdigest(k) for k in keys]
        buckets: list[list[int]] = [[] for _ in range(self.n_buckets)]
        for i, h in enumerate(hashes):
            buckets[h % self.n_buckets].append(i)
        self.displace = [0] * self.n_buckets
        self.order = [-1] * self.n
        free = bytearray(b"\x01") * self.n
        for b in sorted(range(self.n_buckets), key=lambda b: -len(buckets[b])):
            own = buckets[b]
            if len(own) < 2:
                break
            d = 0
            while True:
                slots = {self._spot(hashes[i], d) for i in own}
                if len(slots) == len(own) and all(free[s] for s in slots):
                    break
                d += 1
            self.displace[b] = d
            for i in own:
                s = self._spot(hashes[i], d)
                free[s], self.order[s] = 0, i
        spare = (s for s in range(self.n) if free[s])
        for b, own in enumerate(buckets):
            if len(own) == 1:   # a lone key takes a spare slot directly
                s = next(spare)
                self.displace[b], self.order[s] = -s - 1, own[0]

    def _spot(self, h: int, d: int) -> int:
        x = (h ^ (d * _MUL & _MASK)) * _MUL & _MASK
        return (x >> 29) % self.n

    def slot(self, h: int) -> int:
        d = self.displace[h % self.n_buckets]
        return -d - 1 if d < 0 else self._spot(h, d)


class Vocabulary:
    """Token bytes by rank, and ranks by perfect hash.  Picklable; its size
    is that of the vocabulary file, so it may be broadcast."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        keys = list(ranks)
        self.pattern = pattern
        self.mph = PerfectHash(keys)
        self.keys = [keys[i] for i in self.mph.order]
        self.ranks = [ranks[k] for k in self.keys]
        self.tokens = dict(zip(self.ranks, self.keys))
        self.byte_rank = [ranks[bytes([i])] for i in range(256)]
        content = hashlib.sha256(pattern.encode())
        for r in sorted(self.tokens):
            content.update(b"%d:%d:%b" % (r, len(self.tokens[r]), self.tokens[r]))
        self.digest = content.hexdigest()

    def rank(self, b: bytes) -> int:
        s = self.mph.slot(_xxh64(b))
        return self.ranks[s] if self.keys[s] == b else -1


def _xxh64(b: bytes) -> int:
    import xxhash
    globals()["_xxh64"] = xxhash.xxh64_intdigest
    return xxhash.xxh64_intdigest(b)


def load_vocabulary(path: str, pattern: str) -> Vocabulary:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(r) for a, r in map(bytes.split, f)}
    return Vocabulary(ranks, pattern)


class Encoder:
    """Encodes texts.  Its memos fill up to a bound and then stay as they are:
    what came early holds the frequent entries, the rest is worked out anew."""

    def __init__(self, vocab: Vocabulary):
        import regex
        self.vocab = vocab
        self.pieces = regex.compile(vocab.pattern).findall
        self.chunk_memo: dict[str, bytes] = {}
        self.piece_memo: dict[str, bytes] = {}
        self.pair_memo: dict[int, int] = {}

    def pair(self, key: int) -> int:
        """Rank of two joined tokens (``a << 32 | b``), -1 if they do not merge."""
        tokens = self.vocab.tokens
        r = self.vocab.rank(tokens[key >> 32] + tokens[key & 0xFFFFFFFF])
        if len(self.pair_memo) < MEMO_ENTRIES:
            self.pair_memo[key] = r
        return r

    def merge(self, piece: bytes) -> list[int]:
        """Heap over linked bytes: the ids of a piece outside the vocabulary."""
        known, pair = self.pair_memo.get, self.pair
        ids = list(map(self.vocab.byte_rank.__getitem__, piece))
        n = len(ids)
        bits = n.bit_length()
        low = (1 << bits) - 1
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap, a = [], ids[0]             # entries: rank of the pair, then its place
        for i in range(1, n):
            b = ids[i]
            r = known(a << 32 | b)
            if r is None:
                r = pair(a << 32 | b)
            if r >= 0:
                heap.append(r << bits | i - 1)
            a = b
        heapq.heapify(heap)
        pop, push = heapq.heappop, heapq.heappush
        while heap:
            x = pop(heap)
            i, r = x & low, x >> bits
            a, j = ids[i], after[i]
            if a < 0 or j >= n:
                continue                 # merged away, or the last one by now
            key = a << 32 | ids[j]
            q = known(key)
            if (pair(key) if q is None else q) != r:
                continue                 # another pair stands here by now
            ids[i], ids[j] = r, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                key = r << 32 | ids[k]
                q = known(key)
                if q is None:
                    q = pair(key)
                if q >= 0:
                    push(heap, q << bits | i)
            p = before[i]
            if p >= 0:
                key = ids[p] << 32 | r
                q = known(key)
                if q is None:
                    q = pair(key)
                if q >= 0:
                    push(heap, q << bits | p)
        return [t for t in ids if t >= 0]

    def piece(self, piece: str) -> bytes:
        b = piece.encode()
        r = self.vocab.rank(b)
        if r >= 0:
            return r.to_bytes(4, "little")
        ids = self.merge(b)
        return struct.pack(f"<{len(ids)}I", *ids)

    def chunk(self, chunk: str) -> bytes:
        # a run of ASCII letters after at most one space is one pre-token
        word = chunk.isascii() and (chunk[1:] if chunk[0] == " " else chunk).isalpha()
        out, memo = [], self.piece_memo
        for p in (chunk,) if word else self.pieces(chunk):
            x = memo.get(p)
            if x is None:
                x = self.piece(p)
                if len(memo) < MEMO_ENTRIES and len(p) < 64:
                    memo[p] = x
            out.append(x)
        return out[0] if len(out) == 1 else b"".join(out)

    def chunks(self, chunks: list[str]) -> list[bytes]:
        return list(map(self.chunk, chunks))

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        parts = split_chunks(text)
        return b"".join(map(memoized(self.chunk_memo, parts, self.chunks), parts))


def memoized(memo: dict, keys: list, make):
    """A lookup that knows every one of ``keys``: from ``memo``, which grows to
    MEMO_ENTRIES, and beyond that from values made for this call alone."""
    new = list(set(keys) - memo.keys()) if len(memo) < len(keys) else [k for k in set(keys) if k not in memo]
    if not new:
        return memo.__getitem__
    fresh = dict(zip(new, make(new)))
    if len(memo) + len(fresh) <= MEMO_ENTRIES:
        memo.update(fresh)
        return memo.__getitem__
    return lambda k: fresh[k] if k in fresh else memo[k]


_SPACES = [chr(i) for i in range(0x3001) if chr(i).isspace()]


def split_chunks(text: str) -> list[str]:
    """Cut before each single space that stands between non-space characters;
    the chunks concatenate to the text."""
    parts = text.split(" ")
    here = [c for c in _SPACES if c in text]
    if not (text[0].isspace() or text[-1].isspace() or any(c + " " in text or " " + c in text for c in here)):
        return parts[:1] + list(map(" ".__add__, parts[1:]))
    out = [parts[0]]
    solid = bool(parts[0]) and not parts[0][-1].isspace()
    for p in parts[1:]:
        if solid and p and not p[0].isspace():
            out.append(" " + p)
        else:
            out[-1] += " " + p
        solid = bool(p) and not p[-1].isspace()
    return out


def _encoder(shared) -> Encoder:
    """One encoder (and memo) per worker process and vocabulary content."""
    return worker_memo(f"bpe {shared.id}", lambda: Encoder(shared.value))


class _Shared:
    """A broadcast vocabulary with the digest of its content."""

    def __init__(self, bc, digest: str):
        self.bc, self.id = bc, digest

    @property
    def value(self):
        return self.bc.value


def _broadcast(spark: SparkSession, vocab: Vocabulary) -> _Shared:
    return _Shared(spark.sparkContext.broadcast(vocab), vocab.digest)


def encode(df: DataFrame, id_col: str, text_col: str, vocab: Vocabulary) -> DataFrame:
    """One row per input row: ``id_col``, ``ids`` (packed, see module)."""
    bc = _broadcast(df.sparkSession, vocab)

    @F.pandas_udf("binary")
    def enc(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        e = _encoder(bc)
        for s in batches:
            yield pd.Series([e.encode(t) for t in s], dtype=object)

    return keyed(df, id_col, text_col).select(F.col("c0").alias(id_col), enc("c1").alias("ids"))


def decode(df: DataFrame, id_col: str, ids_col: str, vocab: Vocabulary) -> DataFrame:
    """One row per input row: ``id_col``, ``decoded`` (bytes; null ids: empty).
    An id outside the vocabulary fails the job."""
    bc = _broadcast(df.sparkSession, vocab)

    @F.pandas_udf("binary")
    def dec(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tok = bc.value.tokens.__getitem__
        for s in batches:
            yield pd.Series([b"".join(map(tok, np.frombuffer(x or b"", "<u4").tolist())) for x in s], dtype=object)

    return keyed(df, id_col, ids_col).select(F.col("c0").alias(id_col), dec("c1").alias("decoded"))


def round_trip(df: DataFrame, id_col: str, text_col: str, vocab: Vocabulary) -> DataFrame:
    """One row per input row: ``id_col``, ``ids`` and the ``decoded`` bytes of
    those ids, without a second pass over the input."""
    bc = _broadcast(df.sparkSession, vocab)

    @F.pandas_udf("ids binary, decoded binary")
    def both(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        e, tok = _encoder(bc), bc.value.tokens.__getitem__
        for s in batches:
            ids = [e.encode(t) for t in s]
            text = [b"".join(map(tok, np.frombuffer(x, "<u4").tolist())) for x in ids]
            yield pd.DataFrame({"ids": pd.Series(ids, dtype=object), "decoded": pd.Series(text, dtype=object)})

    return (keyed(df, id_col, text_col).select(F.col("c0"), both("c1").alias("b"))
            .select(F.col("c0").alias(id_col), "b.ids", "b.decoded"))


def checked_ids(df: DataFrame, id_col: str, text_col: str, vocab: Vocabulary) -> DataFrame:
    """One row per input row: ``id_col``, ``n_tokens``, ``ids`` and
    ``same_text`` (the ids decode to the text's bytes)."""
    bc = _broadcast(df.sparkSession, vocab)

    @F.pandas_udf("ids binary, same boolean")
    def both(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        e, tok = _encoder(bc), bc.value.tokens.__getitem__
        for s in batches:
            ids = [e.encode(t) for t in s]
            same = [b"".join(map(tok, np.frombuffer(x, "<u4").tolist())) == (t or "").encode() for x, t in zip(ids, s)]
            yield pd.DataFrame({"ids": pd.Series(ids, dtype=object), "same": same})

    return (keyed(df, id_col, text_col).select(F.col("c0"), both("c1").alias("b"))
            .select(F.col("c0").alias(id_col), token_count(F.col("b.ids")).alias("n_tokens"), "b.ids",
                    F.col("b.same").alias("same_text")))


def token_count(ids: Column) -> Column:
    return (F.octet_length(ids) / 4).cast("bigint")


def unpack_ids(ids: Column) -> Column:
    """``array<bigint>`` of a packed value."""
    h = F.hex(ids)
    spot = F.sequence(F.lit(0), token_count(ids).cast("int") - 1)
    word = lambda i: F.conv(F.concat(*[F.substring(h, i * 8 + k, F.lit(2)) for k in (7, 5, 3, 1)]),
                            16, 10).cast("bigint")
    return F.when(token_count(ids) > 0, F.transform(spot, word)).otherwise(F.array().cast("array<bigint>"))
