import random

import numpy as np
import public_tokenizers as P
import pytest
import tokenizers
from pyspark.sql import functions as F

import __spark_entry__ as E
from conftest import SF_SMALL
from rungkit.llm import bpe_stream
from rungkit.llm.common import read

ODD = "ab  '\n\tsSΣİ\x1c\x85 ᠎​12é世😀́_- 　٣'ll've<|"


@pytest.fixture(scope="module")
def vocab():
    return bpe_stream.load_word_vocabulary(P.path("word_bpe_49k.json"))


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(P.path("word_bpe_49k.json"))


def ids_of(packed):
    return np.frombuffer(packed, "<u4").tolist()


def check(e, d, library, text):
    want = library.encode(text, add_special_tokens=False).ids
    assert ids_of(e.encode(text)) == want, repr(text)
    assert d.chunks(e.pieces(text) if text else []) == library.decode(want, skip_special_tokens=False), repr(text)


def test_equals_library(vocab, library):
    e, d = bpe_stream.Encoder(vocab), bpe_stream.Decoder(vocab)
    rng = random.Random(2)
    some = ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    some += ["<|endoftext|>", "a<|startoftext|><|endoftext|> b", "<|ENDOFTEXT|>", "<|endoftext", "A" * 5000, "é" * 3000,
             "世界" * 4000, " " * 400, "!?" * 3000, "transcend" * 900, "ΑΣ ΣΑΣ Σ", "é ́e", "it'S we'LL"]
    for t in some:
        check(e, d, library, t)


def test_every_code_point_equals_library(vocab, library):
    e, d = bpe_stream.Encoder(vocab), bpe_stream.Decoder(vocab)
    points = [c for c in range(1, 0x30000) if not 0xD800 <= c < 0xE000]
    texts = [f"a{chr(c)}B" for c in points]
    for t, want in zip(texts, library.encode_batch_fast(texts, add_special_tokens=False)):
        assert ids_of(e.encode(t)) == want.ids, repr(t)
    for t in texts[::1009]:
        check(e, d, library, t)


def test_transducer_emits_early_in_constant_memory(vocab, library):
    rng = random.Random(4)
    words = [t[:-4] for t in vocab.tokens.values() if t.endswith("</w>") and t[:-4].isalpha() and t[:-4].islower() and t.isascii()]
    for k in range(40):
        word = "".join(rng.choice(words) for _ in range(600)) if k % 2 else "".join(rng.choice("aenrst") for _ in range(4000))
        run, got, first = bpe_stream.Transducer(vocab, vocab.lookahead * 2), [], None
        for at in range(0, len(word), 7):
            got += run.feed(word[at:at + 7].encode())
            first = at if got and first is None else first
        got += run.finish()
        assert got == library.encode(word, add_special_tokens=False).ids
        assert run.most <= vocab.lookahead * 2 and first <= vocab.lookahead * 2 + 7


def test_lookahead_is_sufficient_for_random_merge_lists():
    rng = random.Random(5)
    for _ in range(150):
        tokens, merges = list("abc"), []
        while len(merges) < rng.randint(1, 12):
            a, b = rng.choice(tokens), rng.choice(tokens)
            if a + b not in tokens:
                merges.append((a, b))
                tokens.append(a + b)
        need = bpe_stream.sufficient_lookahead(merges, len)
        rank = {m: r for r, m in enumerate(merges)}

        def bpe(word):
            parts = list(word)
            while True:
                found = [(rank[p], i) for i, p in enumerate(zip(parts, parts[1:])) if p in rank]
                if not found:
                    return parts
                i = min(found)[1]
                parts[i:i + 2] = [parts[i] + parts[i + 1]]

        for _ in range(60):
            head = "".join(rng.choice("abc") for _ in range(rng.randint(need + 1, need + 12)))
            want = [bpe(head + "".join(rng.choice("abc") for _ in range(rng.randint(0, 9)))) for _ in range(4)] + [bpe(head)]
            ends = [{sum(map(len, w[:k])) for k in range(1, len(w) + 1)} for w in want]
            stable = [{x for x in e if x <= len(head) - need} for e in ends]
            assert all(s == stable[0] for s in stable)


def test_list_with_unmade_tokens_has_no_bound():
    with pytest.raises(ValueError):
        bpe_stream.sufficient_lookahead([("ab", "c")], len)


def test_decoder_gives_text_as_soon_as_it_is_complete(vocab):
    e, d = bpe_stream.Encoder(vocab), bpe_stream.Decoder(vocab, joined=False)
    text = "héllo 世界 😀 x"
    state, out = b"", ""
    for t in ids_of(e.encode(text)):
        got, state = d.step(state, t)
        out += got
        assert len(state) < 4
    assert out + d.finish(state) == "héllo 世界 😀 x "
    half = [vocab.inner[b] for b in "世".encode()[:2]]
    assert d.chunks([np.array(half, "<u4").tobytes(), np.array([vocab.last[ord("a")]], "<u4").tobytes()]) == "�a "


def test_memo_bound_does_not_change_results(vocab, library, monkeypatch):
    monkeypatch.setattr(bpe_stream, "MEMO_ENTRIES", 3)
    e, d = bpe_stream.Encoder(vocab), bpe_stream.Decoder(vocab)
    for t in ["one two three four five one two", "a b c d e f g a b"]:
        check(e, d, library, t)
    assert len(e.memo) <= 3 and len(d.memo) <= 3


def test_tables(ready, awkward, nothing, vocab, library):
    want = sorted((r.doc_id or -1, library.encode(r.text or "", add_special_tokens=False).ids) for r in awkward.collect())
    both = bpe_stream.round_trip(awkward, "doc_id", "text", vocab).collect()
    assert sorted((r.doc_id or -1, ids_of(r.ids)) for r in both) == want
    assert all(r.decoded == library.decode(ids_of(r.ids), skip_special_tokens=False) for r in both)
    enc = bpe_stream.encode(awkward, "doc_id", "text", vocab)
    assert sorted((r.doc_id or -1, ids_of(r.ids)) for r in enc.collect()) == want
    dec = bpe_stream.decode(enc, "doc_id", "ids", vocab)
    assert sorted(r.decoded for r in dec.collect()) == sorted(r.decoded for r in both)
    assert bpe_stream.round_trip(nothing, "doc_id", "text", vocab).count() == 0


def test_query_equals_library(ready, library):
    import hashlib
    got = {r.doc_id: r for r in E.queries()["op12_bpe_stream"](ready, SF_SMALL).collect()}
    docs = read(ready, SF_SMALL, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).collect()
    assert len(got) == len(docs)
    for r in docs:
        ids = library.encode(r.text, add_special_tokens=False).ids
        g = got[r.doc_id]
        assert g.n_tokens == len(ids) and g.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert g.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
