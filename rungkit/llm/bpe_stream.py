"""BPE with word ends as a bounded-lookahead streaming transducer.

A merge list decides how far to the right a token can depend on symbols that
have not been read yet.  Let two words share a prefix and run their merges
side by side, lowest rank first.  What they have in common ends at a border;
only a merge (a, b) across the border that one word makes and the other does
not can move it, and it moves it left by the length of a.  The next such merge
(a', b') has a higher rank, and b' begins at the border: down the left edge of
b' lies either ab (in the word that merged) or a, as the left part of a later
merge (in the word that did not).  :func:`sufficient_lookahead` follows these
chains through the ranks and adds up the lengths; the longest sum is the number
of symbols after which a token's end can no longer change, whatever follows.

The encoder therefore holds a window of a few times that many symbols, merges
it, emits the tokens that end before the last ``lookahead`` symbols and drops
them: memory does not grow with the word, and no merge ever spans what was
emitted and what is left, so the rest is encoded as if it stood alone.

The decoder is a state machine as well: its state is the bytes of a character
that is not complete yet (three at most), a step takes one id and gives the
text that is complete with it.  Steps are memoized by (state, id).

What is encoded: special tokens stand for themselves wherever their strings
occur; elsewhere the text is composed (NFC), lower-cased and cut into words by
the vocabulary file's pattern, white space dropped.  Code points that this
Python's Unicode tables do not assign are normalised and cut by the tokenizers
library itself, whose tables may be newer.

Edge cases: a null text is empty (no ids, empty text); repeated rows give
repeated results; an empty table gives an empty table; texts and words of any
length are encoded whole.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import struct
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rungkit.llm.common import keyed, worker_memo

MEMO_ENTRIES = 300_000        # entries of a memo at most; beyond, results are worked out anew
MEMO_LENGTH = 64              # characters of a memoized chunk at most
WINDOW_LOOKAHEADS = 8         # symbols held at most, as a multiple of the lookahead
SHORT = 24                    # symbols merged without a heap
_NONE, _LOW = 1 << 62, (1 << 32) - 1
LIST_BATCH = 256              # texts per call to a memo


def byte_aliases() -> list[str]:
    """The printable character that stands for each byte in vocabulary files:
    itself where it is printable, else the next free one from 256 on."""
    plain = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    out, spare = [], 256
    for b in range(256):
        out.append(chr(b if b in plain else spare))
        spare += b not in plain
    return out


def sufficient_lookahead(merges: list[tuple[str, str]], length) -> int:
    """Symbols after a token's end that decide it, for merges by rank;
    ``length(token)`` is a token's number of symbols.  A list whose tokens are
    not all made by earlier merges has no such bound and raises."""
    made: dict[str, list[int]] = {}           # token: the ranks that make it
    left: dict[str, tuple[list, list]] = {}   # token: ranks that take it as left part, greatest reach so far
    reach, edge = [], []                      # of a merge; of the left edge below the token it makes

    def below(token: str, rank: int) -> int:
        """The longest chain that ends in a token beginning with ``token``,
        over merges before ``rank``."""
        ranks, best = left.get(token, ((), ()))
        i = bisect_left(ranks, rank)
        most = best[i - 1] if i else 0
        return max([most, *(max(reach[r], edge[r]) for r in made.get(token, ()) if r < rank)])

    for rank, (a, b) in enumerate(merges):
        if any(length(x) > 1 and x not in made for x in (a, b)):
            raise ValueError(f"merge {rank} takes a token that no earlier merge makes")
        edge.append(below(a, rank))
        reach.append(length(a) + below(b, rank))
        made.setdefault(a + b, []).append(rank)
        ranks, best = left.setdefault(a, ([], []))
        ranks.append(rank)
        best.append(max(reach[-1], best[-1] if best else 0))
    return max(reach, default=0)


class WordVocabulary:
    """A tokenizers file of kind BPE with a word-end suffix.  Picklable; its
    size is that of the file, so it may be broadcast."""

    def __init__(self, content: str):
        spec = json.loads(content)
        model, self.content = spec["model"], content
        self.digest = hashlib.sha256(content.encode()).hexdigest()
        self.suffix = model["end_of_word_suffix"]
        self.pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        if spec["decoder"] is not None:
            raise ValueError("a vocabulary with a decoder of its own")
        ids = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in ids.items()} | {i: t for t, i in self.special.items()}
        alias = byte_aliases()
        self.inner, self.last = [ids[c] for c in alias], [ids[c + self.suffix] for c in alias]
        merges = [tuple(m) for m in model["merges"]]
        # two ids, the left one shifted: the merge's rank, shifted, and the id it makes
        self.pairs = {ids[a] << 32 | ids[b]: r << 32 | ids[a + b] for r, (a, b) in enumerate(merges)}
        symbols = {t: max(1, len(t) - len(self.suffix) * t.endswith(self.suffix)) for t in ids}
        self.width = {i: symbols[t] for t, i in ids.items()}
        self.lookahead = sufficient_lookahead(merges, symbols.__getitem__)

    def raw(self, token_id: int) -> bytes:
        """A token's bytes; a word's end is a space, a special token its string."""
        t = self.tokens[token_id]
        if t in self.special:
            return t.encode()
        ends = t.endswith(self.suffix)
        back = {c: b for b, c in enumerate(byte_aliases())}
        return bytes(back[c] for c in (t[:-len(self.suffix)] if ends else t)) + b" " * ends


def load_word_vocabulary(path: str) -> WordVocabulary:
    with open(path, encoding="utf-8") as f:
        return WordVocabulary(f.read())


class Transducer:
    """Encodes one word from a stream of its bytes, holding ``window`` symbols
    at most."""

    def __init__(self, vocab: WordVocabulary, window: int | None = None):
        self.vocab, self.held, self.most = vocab, [], 0
        self.ending = dict(zip(vocab.inner, vocab.last))
        self.window = max(window or WINDOW_LOOKAHEADS * vocab.lookahead, vocab.lookahead + 2)

    def feed(self, data: bytes) -> list[int]:
        """Take some bytes; the ids that have become stable."""
        out, at = [], 0
        while at < len(data):
            room = self.window - len(self.held)
            self.held += map(self.vocab.inner.__getitem__, data[at:at + room])
            at += room
            self.most = max(self.most, len(self.held))
            if len(self.held) >= self.window:
                out += self._emit()
        return out

    def _emit(self) -> list[int]:
        # the last symbol may turn out to end the word, so it is not merged yet
        width, out, end = self.vocab.width, [], 0
        stable = len(self.held) - 1 - self.vocab.lookahead
        for t in self.merge(self.held[:-1]):
            if end + width[t] > stable:
                break
            out.append(t)
            end += width[t]
        if not out:      # cannot be: a token is no longer than the lookahead allows
            raise RuntimeError("window below the lookahead")
        del self.held[:end]
        return out

    def finish(self) -> list[int]:
        """The word ends here: its remaining ids."""
        ids, self.held = self.held, []
        if ids:
            ids[-1] = self.ending[ids[-1]]
        return self.merge(ids)

    def word(self, data: bytes) -> list[int]:
        """The ids of a whole word."""
        if len(data) >= self.window:
            return self.feed(data) + self.finish()
        ids = list(map(self.vocab.inner.__getitem__, data))
        ids[-1] = self.ending[ids[-1]]
        return self.merge(ids)

    def merge(self, ids: list[int]) -> list[int]:
        return self._merge_few(list(ids)) if len(ids) <= SHORT else self._merge_many(ids)

    def _merge_few(self, ids: list[int]) -> list[int]:
        known = self.vocab.pairs.get
        found = [known(a << 32 | b, _NONE) for a, b in zip(ids, ids[1:])]
        while found:
            best = min(found)
            if best == _NONE:
                break
            i = found.index(best)
            ids[i] = new = best & _LOW
            del ids[i + 1], found[i]
            if i:
                found[i - 1] = known(ids[i - 1] << 32 | new, _NONE)
            if i < len(found):
                found[i] = known(new << 32 | ids[i + 1], _NONE)
        return ids

    def _merge_many(self, ids: list[int]) -> list[int]:
        known, n = self.vocab.pairs.get, len(ids)
        ids, nxt, prv = list(ids), list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j < n and (m := known(ids[i] << 32 | ids[j])):
                heapq.heappush(heap, (m >> 32, i, j, ids[i], ids[j], m & _LOW))

        for i in range(n - 1):
            offer(i, i + 1)
        while heap:
            _, i, j, a, b, new = heapq.heappop(heap)
            if ids[i] != a or nxt[i] != j or ids[j] != b:
                continue                              # one of the two has changed since
            ids[i], ids[j], nxt[i] = new, -1, nxt[j]
            if nxt[i] < n:
                prv[nxt[i]] = i
            offer(prv[i], i)
            offer(i, nxt[i])
        return [t for t in ids if t >= 0]


class Encoder:
    """Cuts texts into words and runs the transducer over each.  Its memos of
    chunks (what stands between spaces) fill up to a bound and then stay."""

    def __init__(self, vocab: WordVocabulary):
        import regex
        self.vocab, self.run = vocab, Transducer(vocab)
        self.words = regex.compile(vocab.pattern).findall
        self.marks = regex.compile("|".join(map(regex.escape, sorted(vocab.special, key=len, reverse=True)))) if vocab.special else None
        self.memo: dict[str, bytes] = {}
        self.word_memo: dict[bytes, bytes] = {}
        self.library = None

    def cut(self, chunk: str) -> list[bytes]:
        """The words of a chunk without special tokens, as bytes."""
        if chunk.isascii():
            return [w.encode() for w in self.words(chunk.lower())]
        if any(unicodedata.category(c) == "Cn" for c in chunk):
            return self.cut_by_library(chunk)
        # capital sigma's lower case does not depend on what follows it
        text = unicodedata.normalize("NFC", chunk).replace("Σ", "σ").lower()
        return [w.encode() for w in self.words(text)]

    def cut_by_library(self, chunk: str) -> list[bytes]:
        if self.library is None:
            import tokenizers
            self.library = tokenizers.Tokenizer.from_str(self.vocab.content)
            self.back = {c: b for b, c in enumerate(byte_aliases())}
        words = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(chunk))
        return [bytes(map(self.back.__getitem__, w)) for w, _ in words]

    def chunk(self, chunk: str) -> bytes:
        out, memo = [], self.word_memo
        for word in self.cut(chunk):
            x = memo.get(word)
            if x is None:
                ids = self.run.word(word)
                x = struct.pack(f"<{len(ids)}I", *ids)
                if len(memo) < MEMO_ENTRIES and len(word) <= MEMO_LENGTH:
                    memo[word] = x
            out.append(x)
        return out[0] if len(out) == 1 else b"".join(out)

    def pieces(self, text: str) -> list[bytes]:
        """Packed ids of the text's chunks, in order."""
        if self.marks is not None and "<" in text and self.marks.search(text):
            out, at = [], 0
            for m in self.marks.finditer(text):
                out += self._plain(text[at:m.start()])
                out.append(self.vocab.special[m[0]].to_bytes(4, "little"))
                at = m.end()
            return out + self._plain(text[at:])
        return self._plain(text)

    def _plain(self, text: str) -> list[bytes]:
        memo, chunks = self.memo, text.split(" ")
        out = list(map(memo.get, chunks))
        if None in out:
            for i, x in enumerate(out):
                if x is None:
                    c = chunks[i]
                    out[i] = x = self.chunk(c)
                    if len(memo) < MEMO_ENTRIES and len(c) <= MEMO_LENGTH:
                        memo[c] = x
        return out

    def encode(self, text: str | None) -> bytes:
        return b"".join(self.pieces(text)) if text else b""


class Decoder:
    """Ids to text, one id at a time.

    ``joined``: the tokens' strings with a space before each but the first, as
    the library gives them for a vocabulary without a decoder; else the bytes
    that the tokens stand for, a space after each word, what is no UTF-8
    replaced.
    """

    def __init__(self, vocab: WordVocabulary, joined: bool = True):
        self.vocab, self.joined = vocab, joined
        self.machine = codecs.getincrementaldecoder("utf-8")("replace")
        self.steps: dict[tuple[bytes, int], tuple[str, bytes]] = {}
        self.memo: dict[bytes, str] = {}

    def step(self, state: bytes, token_id: int) -> tuple[str, bytes]:
        """The text that is complete with this id, and the next state."""
        got = self.steps.get((state, token_id))
        if got is None:
            data = b" " + self.vocab.tokens[token_id].encode() if self.joined else self.vocab.raw(token_id)
            self.machine.setstate((state, 0))
            got = self.machine.decode(data), self.machine.getstate()[0]
            if len(self.steps) < MEMO_ENTRIES:
                self.steps[state, token_id] = got
        return got

    def stream(self, state: bytes, packed: bytes) -> tuple[str, bytes]:
        out = []
        for t in np.frombuffer(packed, "<u4").tolist():
            text, state = self.step(state, t)
            out.append(text)
        return "".join(out), state

    def finish(self, state: bytes) -> str:
        self.machine.setstate((state, 0))
        return self.machine.decode(b"", True)

    def chunks(self, pieces: list[bytes]) -> str:
        """The text of a sequence of packed ids; runs of ids that start and end
        between characters are memoized."""
        memo, state = self.memo, b""
        out = list(map(memo.get, pieces))
        if None in out:
            for i, x in enumerate(out):
                if x is None or state:
                    clean = not state
                    out[i], state = self.stream(state, pieces[i])
                    if clean and not state and len(memo) < MEMO_ENTRIES and len(pieces[i]) <= 4 * MEMO_LENGTH:
                        memo[pieces[i]] = out[i]
            out.append(self.finish(state))
        text = "".join(out)
        return text[1:] if self.joined else text


def _worker(digest: str, bc) -> tuple[Encoder, Decoder]:
    """One encoder and decoder per worker process and vocabulary content."""
    return worker_memo(f"bpe stream {digest}", lambda: (Encoder(bc.value), Decoder(bc.value)))


def encode(df: DataFrame, id_col: str, text_col: str, vocab: WordVocabulary) -> DataFrame:
    """One row per input row: ``id_col``, ``ids`` (little-endian unsigned
    32-bit integers)."""
    bc, digest = df.sparkSession.sparkContext.broadcast(vocab), vocab.digest

    @F.pandas_udf("binary")
    def enc(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        e, _ = _worker(digest, bc)
        for s in batches:
            yield pd.Series([e.encode(t) for t in s], dtype=object)

    return keyed(df, id_col, text_col).select(F.col("c0").alias(id_col), enc("c1").alias("ids"))


def decode(df: DataFrame, id_col: str, ids_col: str, vocab: WordVocabulary, joined: bool = True) -> DataFrame:
    """One row per input row: ``id_col``, ``decoded`` (text; null ids: empty),
    see :class:`Decoder`.  An id outside the vocabulary fails the job."""
    bc = df.sparkSession.sparkContext.broadcast(vocab)

    @F.pandas_udf("string")
    def dec(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        d = Decoder(bc.value, joined)
        for s in batches:
            yield pd.Series([d.chunks([x]) if x else "" for x in s], dtype=object)

    return keyed(df, id_col, ids_col).select(F.col("c0").alias(id_col), dec("c1").alias("decoded"))


def round_trip(df: DataFrame, id_col: str, text_col: str, vocab: WordVocabulary) -> DataFrame:
    """One row per input row: ``id_col``, ``ids`` and the ``decoded`` text of
    those ids, in one pass over the input."""
    bc, digest = df.sparkSession.sparkContext.broadcast(vocab), vocab.digest

    @F.pandas_udf("ids binary, decoded string")
    def both(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        e, d = _worker(digest, bc)
        for s in batches:
            for lo in range(0, max(len(s), 1), LIST_BATCH):
                pieces = [e.pieces(t) if t else [] for t in s.iloc[lo:lo + LIST_BATCH]]
                yield pd.DataFrame({"ids": pd.Series(list(map(b"".join, pieces)), dtype=object),
                                    "decoded": pd.Series(list(map(d.chunks, pieces)), dtype=object)})

    return (keyed(df, id_col, text_col).select("c0", both("c1").alias("b"))
            .select(F.col("c0").alias(id_col), "b.ids", "b.decoded"))
