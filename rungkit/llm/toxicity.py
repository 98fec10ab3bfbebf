"""Toxicity: gradient-boosted trees over dense features, isotonically
calibrated.

The lexicon is learned first: words and word beginnings that labelled toxic
documents hold clearly more often than others, with their log odds.  Features
are its densities, hits near a second-person word, capitals, punctuation and
obfuscation (signs or digits inside a word, looked up again after undoing
usual substitutions).  Trees are fitted on three quarters of the training
rows and calibrated on the rest (Spark ML's GBTClassifier and
IsotonicRegression).

Only rows whose id is not held out are used for any of it, at most
``FIT_ROWS`` of them (smallest hash of the id); scoring reads whole texts.

Edge cases: a null text is the empty text, whose features are all 0; without
labels of both kinds every score is the share of toxic labels (0 without
labels); of repeated labels for an id the largest counts; labels without a
document are ignored; repeated rows each get their row; an empty table gives
an empty table.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rungkit.llm.bpe import memoized
from rungkit.llm.common import held_out, keyed, saved

FIT_ROWS = 40_000
CALIBRATION_SHARE = 4        # every fourth training row calibrates
LEXICON_ENTRIES = 400
MIN_DOCS, MIN_LOG_ODDS, MIN_Z = 5, 1.0, 4.0
STRONG = 2.5
NEAR_WORDS = 4
BEGINNINGS = (4, 5, 6, 7)
SEED = 6
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch sie tu toi te ton ta tes vous "
                          "votre tú ti tus usted ustedes vosotros".split())
_UNDO = str.maketrans("013457@$!|", "oieastasii", "*.-_")
_TOKENS = re.compile(r"[^\W\d_]+(?:[0-9@$!|*.\-_]+[^\W\d_]+)*").findall
_SIGNS = re.compile(r"[^\w\s]").findall
_CAPITALS = re.compile("[A-Z\u00c0-\u00d6\u00d8-\u00de\u0391-\u03a9\u0410-\u042f]").findall     # Latin, Greek, Cyrillic
N_FEATURES = 14


def _entries(word: str) -> list[str]:
    """A word and its beginnings, the most specific first."""
    return [word, *[word[:k] + "~" for k in sorted(BEGINNINGS, reverse=True) if len(word) > k]]


@dataclass
class Model:
    lexicon: dict[str, float] = field(default_factory=dict)
    trees: object = None
    isotonic: object = None
    constant: float = 0.0


def _weigher(lexicon: dict[str, float]):
    def weigh(words: list[str]) -> list[float]:
        return [max((lexicon[e] for e in _entries(w) if e in lexicon), default=0.0) for w in words]
    return weigh


def text_features(text: str | None, lexicon: dict[str, float], memo: dict[str, float]) -> np.ndarray:
    out = np.zeros(N_FEATURES)
    tokens = _TOKENS(text) if text else []
    if not text:
        return out
    chars = len(text)
    marks = len(_SIGNS(text))
    letters = sum(map(len, tokens))
    upper = len(_CAPITALS(text))
    out[8], out[9], out[10] = upper / max(letters, 1), marks / chars, text.count("!") / chars
    n = len(tokens)
    out[13] = np.log1p(n)
    if not n:
        return out
    plain = list(map(str.lower, tokens))
    hidden = [i for i, t in enumerate(plain) if not t.isalpha()]
    for i in hidden:
        plain[i] = plain[i].translate(_UNDO)
    w = np.fromiter(map(memoized(memo, plain, _weigher(lexicon)), plain), dtype=np.float64, count=n)
    strong = w >= STRONG
    hits = int(strong.sum())
    out[0], out[1], out[2] = hits / n, np.log1p(hits), w.sum() / np.sqrt(n)
    out[3], out[4] = ((w > 0) & ~strong).sum() / n, w.max()
    out[5] = len({plain[i] for i in np.flatnonzero(strong)}) if hits else 0
    you = np.fromiter((t in SECOND_PERSON for t in plain), dtype=bool, count=n)
    if hits and you.any():
        near = np.cumsum(np.concatenate([[0], you]))
        at = np.flatnonzero(strong)
        out[6] = (near[np.minimum(at + NEAR_WORDS + 1, n)] > near[np.maximum(at - NEAR_WORDS, 0)]).mean()
    out[7] = you.mean()
    out[11] = len(hidden) / n
    out[12] = float(strong[hidden].sum()) if hidden else 0.0
    return out


def with_features(rows: DataFrame, lexicon: dict[str, float]) -> DataFrame:
    """``rows`` (with text column c1) plus ``features`` (ML vector), c1 dropped."""
    from pyspark.ml.functions import array_to_vector
    shared = rows.sparkSession.sparkContext.broadcast(lexicon)      # at most LEXICON_ENTRIES

    @F.pandas_udf("array<double>")
    def features(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        memo: dict[str, float] = {}
        for s in batches:
            yield pd.Series([text_features(t, shared.value, memo).tolist() for t in s], dtype=object)

    return rows.withColumn("features", array_to_vector(features("c1"))).drop("c1")


def learn_lexicon(rows: DataFrame, n_toxic: int, n_clean: int) -> dict[str, float]:
    """``rows``: c1 (text), label (0/1); a bounded fitting sample."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = (Counter(), Counter())
        for pdf in batches:
            for text, label in zip(pdf["c1"], pdf["label"]):
                words = set(map(str.lower, _TOKENS(text or "")))
                seen[int(label == 1)].update({e for w in words for e in _entries(w)})
            if sum(map(len, seen)) > 2_000_000:
                yield from _flush(seen)
        yield from _flush(seen)

    n_t, n_c = F.lit(float(n_toxic)), F.lit(float(n_clean))
    p_t, p_c = (F.col("toxic") + 0.5) / (n_t + 1), (F.col("clean") + 0.5) / (n_c + 1)
    p = (F.col("toxic") + F.col("clean") + 1.0) / (n_t + n_c + 2)
    entries = (rows.select("c1", "label").mapInPandas(count, "entry string, toxic bigint, clean bigint")
               .groupBy("entry").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
               .where(F.col("toxic") >= MIN_DOCS)
               .withColumn("w", F.log(p_t / p_c))
               .withColumn("z", (p_t - p_c) / F.sqrt(p * (1 - p) * (1 / n_t + 1 / n_c)))
               .where((F.col("w") >= MIN_LOG_ODDS) & (F.col("z") >= MIN_Z)))
    best = entries.orderBy(F.desc("z"), "entry").select("entry", "w").limit(LEXICON_ENTRIES).collect()
    return {r["entry"]: r["w"] for r in best}


def _flush(seen: tuple[Counter, Counter]) -> Iterator[pd.DataFrame]:
    clean, toxic = seen
    names = list(toxic.keys() | clean.keys())
    for lo in range(0, len(names), 200_000):
        part = names[lo:lo + 200_000]
        yield pd.DataFrame({"entry": part, "toxic": [toxic[e] for e in part], "clean": [clean[e] for e in part]})
    clean.clear()
    toxic.clear()


def fit(df: DataFrame, id_col: str, text_col: str, labels: DataFrame, label_id: str, label_col: str) -> Model:
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.regression import IsotonicRegression

    docs = keyed(df, id_col, text_col)
    lab = (keyed(labels, label_id, label_col).where("c0 is not null and c1 is not null")
           .where(~held_out(F.col("c0"))).groupBy(F.col("c0").alias("id")).agg(F.max("c1").alias("label"))
           .join(docs.select(F.col("c0").alias("id")), "id", "left_semi")       # labels of other documents are no use
           .orderBy(F.xxhash64("id"), "id").limit(FIT_ROWS))
    rows = saved(docs.join(F.broadcast(lab), F.col("c0") == F.col("id"))     # at most FIT_ROWS ids
                 .select("c0", F.coalesce("c1", F.lit("")).alias("c1"), (F.col("label") == 1).cast("double").alias("label")),
                 "toxic-fit")
    n = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    toxic, clean = n.get(1.0, 0), n.get(0.0, 0)
    if not toxic or not clean:
        return Model(constant=toxic / max(toxic + clean, 1))
    lexicon = learn_lexicon(rows, toxic, clean)
    featured = saved(with_features(rows, lexicon), "toxic-features")
    part = F.pmod(F.xxhash64("c0", F.lit(SEED)), F.lit(CALIBRATION_SHARE))
    train, calibrate = featured.where(part != 0), featured.where(part == 0)
    if train.select("label").distinct().count() < 2:
        train = featured
    trees = GBTClassifier(maxIter=20, maxDepth=3, stepSize=0.3, seed=SEED, maxBins=64).fit(train.select("features", "label"))
    judged = trees.transform(calibrate if calibrate.limit(1).count() else featured)
    judged = judged.select(vector_to_array("probability")[1].alias("p"), "label")
    return Model(lexicon, trees, IsotonicRegression(featuresCol="p", labelCol="label").fit(judged), 0.0)


def score(df: DataFrame, id_col: str, text_col: str, model: Model) -> DataFrame:
    """One row per input row: ``id_col``, ``score`` (0 to 1)."""
    from pyspark.ml.functions import vector_to_array
    rows = keyed(df, id_col, text_col)
    if model.trees is None:
        return rows.select(F.col("c0").alias(id_col), F.lit(float(model.constant)).alias("score"))
    judged = model.trees.transform(with_features(rows, model.lexicon))
    judged = judged.select("c0", vector_to_array("probability")[1].alias("p"))
    out = model.isotonic.setFeaturesCol("p").setPredictionCol("score").transform(judged)
    return out.select(F.col("c0").alias(id_col), F.greatest(F.lit(0.0), F.least(F.lit(1.0), "score")).alias("score"))
