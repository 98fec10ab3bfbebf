import base64
import random

import numpy as np
import public_tokenizers as P
import pytest

from rungkit.llm import bpe
from rungkit.llm.token_counts import Counter, read_cache, token_counts
from rungkit.session import scratch_path

ODD = "ab  '\n\tsS\x1c\x85 ᠎​12é世😀́_- 　٣'ll've"


@pytest.fixture(scope="module")
def vocab():
    return bpe.load_vocabulary(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)


@pytest.fixture(scope="module")
def library():
    import tiktoken
    with open(P.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    rng = random.Random(1)
    return (["".join(rng.choice(ODD) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
            + ["a" * 5000, "é" * 3000, " " * 500, "x" + " " * 9 + "y", "!?" * 2000])


def test_perfect_hash_is_minimal_and_exact(vocab):
    assert sorted(vocab.mph.order) == list(range(vocab.mph.n))
    assert all(vocab.rank(k) == r for k, r in zip(vocab.keys, vocab.ranks))
    assert vocab.rank(b"certainly no token of the vocabulary") == -1


def test_encoder_equals_library_and_round_trips(vocab, library):
    e = bpe.Encoder(vocab)
    for t in texts():
        ids = np.frombuffer(e.encode(t), "<u4").tolist()
        assert ids == library.encode_ordinary(t), repr(t)
        assert b"".join(map(vocab.tokens.__getitem__, ids)) == t.encode()


def test_memo_bound_does_not_change_results(vocab, library, monkeypatch):
    monkeypatch.setattr(bpe, "MEMO_ENTRIES", 5)
    e = bpe.Encoder(vocab)
    for t in texts()[:300]:
        assert np.frombuffer(e.encode(t), "<u4").tolist() == library.encode_ordinary(t)
    assert len(e.chunk_memo) <= 5 and len(e.pair_memo) <= 5


def test_chunks_concatenate():
    for t in texts():
        if t:
            assert "".join(bpe.split_chunks(t)) == t


def test_encode_decode_tables(ready, awkward, nothing, vocab, library):
    enc = bpe.encode(awkward, "doc_id", "text", vocab)
    rows = enc.select("doc_id", "ids", bpe.unpack_ids(enc.ids).alias("list")).collect()
    assert len(rows) == awkward.count()
    want = sorted(str(library.encode_ordinary(r.text or "")) for r in awkward.collect())
    assert sorted(str(list(r.list)) for r in rows) == want
    back = bpe.decode(enc, "doc_id", "ids", vocab)
    assert sorted(bytes(r.decoded) for r in back.collect()) == sorted((r.text or "").encode() for r in awkward.collect())
    assert bpe.encode(nothing, "doc_id", "text", vocab).count() == 0
    assert all(r.same_text for r in bpe.checked_ids(awkward, "doc_id", "text", vocab).collect())


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_counts_equal_library(name):
    c = Counter(P.path(name))
    some = [t + x for t, x in zip(texts()[:600], ["", "<|endoftext|>", " <|endoftext|> b"] * 200)] + ["", "a" * 3000]
    got = c.count(some)
    if name.endswith("json"):
        import tokenizers
        t = tokenizers.Tokenizer.from_file(P.path(name))
        want = [len(t.encode(x, add_special_tokens=False).ids) for x in some]
    else:
        import sentencepiece
        want = [len(x) for x in sentencepiece.SentencePieceProcessor(model_file=P.path(name)).encode(some)]
    assert got == want


def test_cache_encodes_distinct_misses_once(ready, awkward, nothing):
    c = Counter(P.path("byte_bpe_50k.json"))
    path = scratch_path(ready, "test-cache")
    first = token_counts(awkward, "doc_id", "text", c, path)
    assert first.count() == awkward.count()
    distinct = len({r.text or "" for r in awkward.collect()})
    assert read_cache(ready, path).count() == distinct
    again = token_counts(awkward, "doc_id", "text", c, path)       # all hits: nothing is appended
    assert again.count() == awkward.count() and read_cache(ready, path).count() == distinct
    more = token_counts(awkward.unionByName(awkward.limit(1).selectExpr("*").replace("x", "x")), "doc_id", "text", c, path)
    assert more.count() == awkward.count() + 1
    for r in first.collect():
        assert (r.n_bytes, r.n_tokens) != (0, 1)
    by = {r.doc_id: r for r in first.collect()}
    assert (by[3].n_bytes, by[3].n_tokens, by[4].n_tokens) == (0, 0, 0)
    assert token_counts(nothing, "doc_id", "text", c).count() == 0
