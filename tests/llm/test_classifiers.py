import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from conftest import SF_MID
from rungkit.llm import language, quality, toxicity
from rungkit.llm.common import grid_value, held_out, kth_largest, read


def test_kth_largest_equals_sort(ready):
    x = [float(v) for v in np.random.default_rng(0).normal(0, 50, 400)] + [3.25] * 20 + [None]
    df = ready.createDataFrame([(v,) for v in x], "x double").withColumn("g", grid_value(F.col("x")))
    s = sorted((v for v in x if v is not None), reverse=True)
    for k in (1, 7, 200, 420):
        assert abs(kth_largest(df, "x", k) - s[k - 1]) < 1e-9
    assert kth_largest(df, "x", 421) is None


def test_held_out_is_crc32_of_decimal_text(ready):
    import zlib
    got = ready.range(200).select("id", held_out(F.col("id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 4 == 2) for r in got)


def test_importance_weights_equal_brute_force(ready, awkward):
    labels = ready.createDataFrame([(1, 1), (1, 1), (7, 0), (9, 1), (99, 1), (None, 1), (4, None)], "doc_id bigint, quality int")
    out = quality.importance(awkward, "doc_id", "text", labels, "doc_id", "quality", keep_share=0.5).collect()
    assert len(out) == awkward.count()
    rows = awkward.select("doc_id", "text").collect()
    raw, target = np.ones(quality.BUCKETS), np.ones(quality.BUCKETS)
    for r in rows:
        for b in quality.ngram_buckets(r.text):
            raw[b] += 1
            target[b] += r.doc_id in (1, 9)
    w = np.log(target / target.sum()) - np.log(raw / raw.sum())
    want = sorted(round(float(w[quality.ngram_buckets(r.text)].sum()), 6) for r in rows)
    assert sorted(round(r.log_weight, 6) for r in out) == want
    keys = sorted((r.sample_key for r in out), reverse=True)
    cut = keys[round(0.5 * len(out)) - 1]
    assert all(r.kept == (r.sample_key >= cut - 1e-9) for r in out)


def test_importance_without_labels_keeps_all(ready, awkward, nothing):
    empty = ready.createDataFrame([], "doc_id bigint, quality int")
    assert all(r.kept for r in quality.importance(awkward, "doc_id", "text", empty, "doc_id", "quality").collect())
    assert quality.importance(nothing, "doc_id", "text", empty, "doc_id", "quality").count() == 0


def test_quality_keeps_good_and_drops_bad(ready):
    out = E.queries()["op4_quality"](ready, SF_MID).join(read(ready, SF_MID, "labels"), "doc_id")
    got = {r.quality: r.m for r in out.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("m")).collect()}
    assert got[1] >= 0.97 and got[0] <= 0.25


def _slow_vector(text):
    letters = " " + "".join(c if c.isalpha() else " " for c in text.lower()) + " "
    letters = " ".join([""] + letters.split() + [""])
    out = np.zeros(language.DIM)
    for a, b, c in zip(letters, letters[1:], letters[2:]):
        if b != " ":
            v = np.roll(language._letter(ord(a)), 2).astype(int) * np.roll(language._letter(ord(b)), 1) * language._letter(ord(c))
            out += v
    n = np.linalg.norm(out)
    return out / n if n else out


def test_text_vectors_equal_definition():
    some = ["Hello, world", "", None, "123 !!", "a", "été à la plage", "x y", "世界 hello", "B" * 700]
    got = language.text_vectors(some)
    for t, v in zip(some, got):
        assert np.allclose(v, _slow_vector(t or ""), atol=1e-5), t


def test_language_edge_cases(ready, awkward, nothing):
    langs, proto = language.fit(awkward, "doc_id", "text", "lang")
    out = {r.doc_id: r for r in language.predict(awkward, "doc_id", "text", langs, proto).collect()}
    assert out[3].lang_pred == out[4].lang_pred == out[5].lang_pred == "und" and out[3].score == 0
    assert out[1].lang_pred in langs and 0 <= out[1].score <= 1
    assert language.fit(nothing, "doc_id", "text", "lang")[0] == []
    assert {r.lang_pred for r in language.predict(awkward, "doc_id", "text", [], np.zeros((0, language.DIM))).collect()} == {"und"}


def test_language_held_out_accuracy(ready):
    out = E.queries()["op5_language"](ready, SF_MID).join(read(ready, SF_MID, "documents"), "doc_id").where("held_out")
    assert out.select(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] >= 0.97


def test_toxicity_edge_cases(ready, awkward, nothing):
    labels = ready.createDataFrame([(1, 0), (None, 1), (50, 1), (4, None)], "doc_id bigint, toxic int")
    one_kind = toxicity.fit(awkward, "doc_id", "text", labels, "doc_id", "toxic")
    assert {r.score for r in toxicity.score(awkward, "doc_id", "text", one_kind).collect()} == {0.0}
    assert toxicity.score(nothing, "doc_id", "text", one_kind).count() == 0
    f = toxicity.text_features("You IDIOT! 1d1ot you", {"idiot": 3.0}, {})
    assert f[0] > 0 and f[6] == 1 and f[8] > 0 and f[10] > 0
    assert not toxicity.text_features(None, {}, {}).any() and not toxicity.text_features("", {}, {}).any()


@pytest.mark.parametrize("share", [0.9])
def test_toxicity_separates_held_out(ready, share):
    out = (E.queries()["op6_toxicity"](ready, SF_MID).join(read(ready, SF_MID, "labels"), "doc_id")
           .join(read(ready, SF_MID, "documents").where("lang = 'en'"), "doc_id").where("held_out").collect())
    toxic = [r.predicted for r in out if r.toxic == 1]
    clean = [r.predicted for r in out if r.toxic == 0]
    assert sum(toxic) / len(toxic) >= share and sum(clean) / len(clean) <= 0.05
    assert all(0 <= r.score <= 1 for r in out)


def test_language_prototypes_and_choice_equal_brute_force(ready, awkward):
    words = {"a": "alpha beta gamma delta", "b": "uno dos tres cuatro cinco", "c": "ein zwei drei vier"}
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(rng.choice(w.split(), 12)) + ("!" if i % 2 else ""), lang) for lang, w in words.items()
            for i in range(ord(lang) * 20, ord(lang) * 20 + 15)]
    rows += [(5000, "uno dos", None), (5001, None, "a"), (5002, "", "b"), (5003, "zwei vier vier", "c")]
    df = ready.createDataFrame(rows, "doc_id bigint, text string, lang string")
    import zlib
    proto = {}
    for i, t, lang in rows:
        if lang and zlib.crc32(str(i).encode()) % 4 != 2:
            proto[lang] = proto.get(lang, 0) + _slow_vector(t or "")
    want = {x: v / np.linalg.norm(v) for x, v in proto.items()}
    langs, got = language.fit(df, "doc_id", "text", "lang")
    assert langs == sorted(want) and np.allclose(got, [want[x] for x in langs], atol=1e-5)
    out = {r.doc_id: r for r in language.predict(df, "doc_id", "text", langs, got).collect()}
    for i, t, _ in rows:
        cos = [float(_slow_vector(t or "") @ want[x]) for x in langs]
        if not any(c.isalpha() for c in t or ""):
            assert (out[i].lang_pred, out[i].score) == ("und", 0.0)
        else:
            assert out[i].lang_pred == langs[int(np.argmax(cos))] and abs(out[i].score - max(0.0, max(cos))) < 1e-4


def _slow_lexicon(rows):
    from collections import Counter
    seen, n = (Counter(), Counter()), [sum(y == k for _, y in rows) for k in (0, 1)]
    for text, y in rows:
        own = set()
        for w in toxicity._TOKENS(text or ""):
            w = w.lower()
            own |= {w} | {w[:k] + "~" for k in toxicity.BEGINNINGS if len(w) > k}
        seen[y].update(own)
    out = []
    for e, t in seen[1].items():
        c = seen[0][e]
        pt, pc, p = (t + .5) / (n[1] + 1), (c + .5) / (n[0] + 1), (t + c + 1) / (sum(n) + 2)
        w, z = np.log(pt / pc), (pt - pc) / np.sqrt(p * (1 - p) * (1 / n[1] + 1 / n[0]))
        if t >= toxicity.MIN_DOCS and w >= toxicity.MIN_LOG_ODDS and z >= toxicity.MIN_Z:
            out.append((-z, e, w))
    return {e: w for _, e, w in sorted(out)[:toxicity.LEXICON_ENTRIES]}


def test_lexicon_equals_brute_force(ready):
    rng = np.random.default_rng(6)
    plain, bad = [f"word{i}x" for i in range(60)], ["awful", "awfully", "dreadful"]
    rows = []
    for i in range(400):
        y = int(rng.random() < 0.3)
        w = list(rng.choice(plain, int(rng.integers(0, 30)))) + (list(rng.choice(bad, 2)) if y and rng.random() < 0.8 else [])
        rows.append((" ".join(w) if i % 50 else None, y))
    df = ready.createDataFrame(rows, "c1 string, label int").repartition(3)
    got = toxicity.learn_lexicon(df, sum(y for _, y in rows), sum(1 - y for _, y in rows))
    want = _slow_lexicon(rows)
    assert got.keys() == want.keys() and "awful" in got and all(abs(got[e] - want[e]) < 1e-9 for e in want)


def test_features_equal_definition():
    lexicon = {"awful": 3.0, "drea~": 1.5, "idiot": 2.6}
    for text in ["You are awful!! DREADFUL", "aw-ful 1diot id1ot you", "no signs here", "éÀ? ¿tú idiot", "", "!!", "idiot a b c d e you idiot"]:
        f = toxicity.text_features(text, lexicon, {})
        tokens = toxicity._TOKENS(text)
        low = [t.lower() if t.isalpha() else t.lower().translate(toxicity._UNDO) for t in tokens]
        w = [max([lexicon.get(e, 0.0) for e in [x, *[x[:k] + "~" for k in toxicity.BEGINNINGS if len(x) > k]]]) for x in low]
        n, strong = len(tokens), [i for i, x in enumerate(w) if x >= toxicity.STRONG]
        if not text:
            assert not f.any()
            continue
        marks = sum(not c.isspace() and not (c.isalnum() or c == "_") for c in text)
        assert np.isclose(f[9], marks / len(text)) and np.isclose(f[10], text.count("!") / len(text)) and np.isclose(f[13], np.log1p(n))
        if n:
            you = [x in toxicity.SECOND_PERSON for x in low]
            near = [any(you[max(0, i - toxicity.NEAR_WORDS):i + toxicity.NEAR_WORDS + 1]) for i in strong]
            want = [len(strong) / n, np.log1p(len(strong)), sum(w) / np.sqrt(n), sum(0 < x < toxicity.STRONG for x in w) / n, max(w),
                    len({low[i] for i in strong}), np.mean(near) if strong and any(you) else 0.0, np.mean(you)]
            assert np.allclose(f[:8], want), text
            assert np.isclose(f[11], sum(not t.isalpha() for t in tokens) / n)
            assert np.isclose(f[12], sum(not tokens[i].isalpha() for i in strong))


def test_toxicity_in_all_languages(ready):
    """Texts of the other languages that are labelled toxic in this table carry
    no sign of it (no word of the lexicon, no address, capitals or marks beyond
    the clean ones), so only those that do are expected to be caught."""
    docs, labels = read(ready, SF_MID, "documents"), read(ready, SF_MID, "labels")
    model = toxicity.fit(docs, "doc_id", "text", labels, "doc_id", "toxic")
    out = (E.queries()["op6_toxicity"](ready, SF_MID).join(labels, "doc_id").join(docs.select("doc_id", "text", "lang"), "doc_id")
           .where("held_out").collect())
    signs = {r.doc_id: toxicity.text_features(r.text, model.lexicon, {})[1] > 0 for r in out}
    toxic = [r.predicted for r in out if r.toxic == 1 and signs[r.doc_id]]
    assert toxic and np.mean(toxic) >= 0.9
    assert np.mean([r.predicted for r in out if r.toxic == 0]) <= 0.05


def test_labels_without_documents_do_not_use_up_the_sample(ready, monkeypatch):
    monkeypatch.setattr(toxicity, "FIT_ROWS", 60)
    docs = ready.range(50).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "bad awful").otherwise("fine good").alias("text"))
    labels = ready.range(5000).select(F.col("id").alias("doc_id"), (F.col("id") % 2 == 0).cast("int").alias("toxic"))
    assert toxicity.fit(docs, "doc_id", "text", labels, "doc_id", "toxic").lexicon
