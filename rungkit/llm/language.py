"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +-1 seeded by its code point.  A trigram
is the product (binding) of its letters' vectors, rotated by two, one and no
places (permutation) so that order counts.  A text's vector is the sum
(bundling) of its trigrams, a language's prototype the sum of the unit
vectors of its training texts, and a text gets the language of the nearest
prototype by cosine.

Letters are lower-cased, everything else separates words.  Training takes at
most about ``TRAIN_ROWS`` texts of each language, drawn by a hash of the id;
prediction reads whole texts.

Edge cases: a null text or one without a letter is ``und`` with score 0, as
is every text when there is nothing to learn from; equal cosines go to the
alphabetically first language; a negative cosine scores 0; repeated rows each
get their row; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rungkit.llm.common import held_out, keyed, uniform_open

DIM = 1024
SEED = 5
TRAIN_ROWS = 4_000
MAX_LANGUAGES = 1_000
UNKNOWN = "und"
_GROUP_CHARS = 300_000     # letters whose trigrams are counted together
_TRIGRAMS = 4096

_letters: np.ndarray | None = None
_vectors: dict[int, np.ndarray] = {}


def _is_letter() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.array([chr(i).isalpha() for i in range(0x110000)])
    return _letters


def _letter(code: int) -> np.ndarray:
    v = _vectors.get(code)
    if v is None:
        v = np.random.default_rng([SEED, code]).integers(0, 2, DIM, dtype=np.int8) * np.int8(2) - np.int8(1)
        _vectors[code] = v
    return v


def _groups(texts: list) -> Iterator[list]:
    """Texts in runs of limited length; a longer text stands alone."""
    run, size = [], 0
    for t in texts:
        t = (t or "").lower()
        if run and (size + len(t) > _GROUP_CHARS or len(run) == 128):
            yield run
            run, size = [], 0
        run.append(t)
        size += len(t)
    if run:
        yield run


def text_vectors(texts: list) -> np.ndarray:
    """One bundled vector per text, scaled to length 1 (zero: no letter)."""
    out = [_bundle(run) for run in _groups(texts)]
    return np.concatenate(out) if out else np.zeros((0, DIM), dtype=np.float32)


def _bundle(texts: list[str]) -> np.ndarray:
    sums = np.zeros((len(texts), DIM), dtype=np.float32)
    code = np.frombuffer(" ".join(["", *texts, ""]).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
    owner = np.repeat(np.arange(len(texts) + 1), [1, *[len(t) + 1 for t in texts]])
    owner = np.maximum(owner - 1, 0)
    code = np.where(_is_letter()[code], code, 32)
    gap = code == 32
    keep = np.ones(len(code), dtype=bool)
    keep[1:] = ~(gap[1:] & gap[:-1])
    code, owner = code[keep], owner[keep]
    if len(code) < 3:
        return sums
    who = owner[1:-1]                # a trigram belongs to its middle letter
    tri = code[:-2] << 42 | code[1:-1] << 21 | code[2:]
    middle = code[1:-1] != 32        # one within or at the edge of a word
    which, at = np.unique(tri[middle], return_inverse=True)
    if not len(which):
        return sums
    letters, spot = np.unique(np.concatenate([which >> 42, which >> 21 & 0x1FFFFF, which & 0x1FFFFF]),
                              return_inverse=True)
    table = np.stack([_letter(int(c)) for c in letters])
    first, second, third = spot.reshape(3, -1)
    two, one = np.roll(table, 2, axis=1), np.roll(table, 1, axis=1)
    order = np.argsort(at, kind="stable")
    at, who = at[order], who[middle][order]
    for lo in range(0, len(which), _TRIGRAMS):        # a table of texts x _TRIGRAMS counts at a time
        s = slice(lo, lo + _TRIGRAMS)
        a, b = np.searchsorted(at, [lo, lo + _TRIGRAMS])
        n = len(which[s])
        counts = np.bincount(who[a:b] * n + at[a:b] - lo, minlength=len(texts) * n).reshape(len(texts), n).astype(np.float32)
        sums += counts @ (two[first[s]] * one[second[s]] * table[third[s]]).astype(np.float32)
    norm = np.sqrt((sums.astype(np.float64) ** 2).sum(axis=1, keepdims=True))
    return (sums / np.where(norm > 0, norm, 1)).astype(np.float32)


def fit(df: DataFrame, id_col: str, text_col: str, lang_col: str) -> tuple[list[str], np.ndarray]:
    """Languages and their prototypes, from rows with a language that are not
    held out."""
    rows = keyed(df, id_col, text_col, lang_col).where(F.col("c2").isNotNull() & ~held_out(F.col("c0")))
    found = rows.groupBy("c2").count().orderBy(F.desc("count"), "c2").limit(MAX_LANGUAGES + 1).collect()
    if len(found) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not found:
        return [], np.zeros((0, DIM))
    rate = F.create_map(*[x for r in found for x in (F.lit(r["c2"]), F.lit(min(1.0, TRAIN_ROWS / r["count"])))])

    def bundle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for pdf in batches:
            for lang, own in pdf.groupby("c2"):
                v = text_vectors(own["c1"].tolist()).sum(axis=0, dtype=np.float64)
                sums[lang] = sums.get(lang, 0) + v
        for lang, v in sums.items():
            # whole numbers, so that the order of the sums doesn't matter
            yield pd.DataFrame({"lang": lang, "spot": np.arange(DIM), "x": np.rint(v * 2 ** 20).astype(np.int64)})

    train = rows.where(uniform_open(F.col("c0"), seed=SEED) < F.element_at(rate, F.col("c2")))
    proto: dict[str, np.ndarray] = {}
    for r in (train.select("c1", "c2").mapInPandas(bundle, "lang string, spot int, x bigint")
              .groupBy("lang", "spot").agg(F.sum("x").alias("x")).collect()):   # languages x DIM
        proto.setdefault(r["lang"], np.zeros(DIM))[r["spot"]] = r["x"]
    langs = sorted(x for x in proto if proto[x].any())
    return langs, np.array([proto[x] / np.linalg.norm(proto[x]) for x in langs]).reshape(len(langs), DIM)


def predict(df: DataFrame, id_col: str, text_col: str, langs: list[str], prototypes: np.ndarray) -> DataFrame:
    """One row per input row: ``id_col``, ``lang_pred``, ``score``."""
    shared = df.sparkSession.sparkContext.broadcast((langs, prototypes.astype(np.float32)))

    @F.pandas_udf("lang string, score double")
    def nearest(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names, proto = shared.value
        names = np.array(names + [UNKNOWN], dtype=object)
        for s in batches:
            v = text_vectors(s.tolist())
            if not len(proto):
                best, score = np.full(len(v), -1), np.zeros(len(v))
            else:
                cos = v @ proto.T
                best = cos.argmax(axis=1)
                score = np.clip(cos[np.arange(len(v)), best].astype(np.float64), 0, 1)
                best = np.where(v.any(axis=1), best, -1)
            yield pd.DataFrame({"lang": names[best], "score": np.where(best < 0, 0.0, score)})

    return (keyed(df, id_col, text_col).select("c0", nearest("c1").alias("p"))
            .select(F.col("c0").alias(id_col), F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score")))
