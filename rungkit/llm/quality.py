"""Quality by importance resampling.

Two generative models over hashed n-grams: the target model from documents
labelled good, the raw model from all documents.  A document's log weight is
the sum over its n-grams of log p_target - log p_raw.  Adding independent
Gumbel noise and keeping the k largest keys draws k documents without
replacement with probabilities that follow the weights (Gumbel top-k).

N-grams: words and signs, pairs of neighbours (a pair of equal ones is one
n-gram of its own, whatever the word), and pairs of word shapes, hashed into
``BUCKETS`` cells.

The target model is fitted on a bounded sample of good documents
(``TARGET_ROWS``, by smallest hash of the id); the raw model and everything
else covers all documents and whole texts.  The k-th key is found by counting
(:func:`rungkit.llm.common.kth_largest`), so no task sorts the keys.

Edge cases: a null or empty text has no n-grams and weight 0; rows with the
same id and text have the same key, and rows that tie with the k-th key are
all kept; labels without a row in the documents, null labels and repeated
labels (the smallest counts) are harmless; with no label at all both models
agree and every document is kept; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rungkit.llm.bpe import memoized
from rungkit.llm.common import grid_value, keyed, kth_largest, saved, uniform_open, worker_memo

BUCKETS = 1 << 16
TARGET_ROWS = 20_000
SMOOTHING = 1.0          # pseudo-count of every bucket
SEED = 4
_WORDS = re.compile(r"\w+|[^\w\s]").findall
_MUL = np.uint64(0x9E3779B97F4A7C15)


def _shape(w: str) -> int:
    case = 0 if w.islower() else 1 if w.istitle() else 2 if w.isupper() else 3 if w.isdigit() else 4
    return case * 4 + min(len(w), 12) // 4


def _word_codes(words: list[str]) -> list[int]:
    """Hash of the lower-cased word above 6 bits of shape."""
    import xxhash
    return [xxhash.xxh64_intdigest(w.lower()) >> 6 << 6 | _shape(w) for w in words]


def ngram_buckets(text: str | None) -> np.ndarray:
    words = _WORDS(text) if text else []
    n = len(words)
    if not n:
        return np.empty(0, dtype=np.int64)
    code = np.fromiter(map(memoized(worker_memo("quality words", dict), words, _word_codes), words), dtype=np.uint64, count=n)
    word, shape = code >> np.uint64(6), code & np.uint64(63)
    a, b = word[:-1], word[1:]
    pair = np.where(a == b, np.uint64(1), a * np.uint64(31) + b)
    grams = np.concatenate([word, pair, shape[:-1] * np.uint64(64) + shape[1:] + np.uint64(7 << 40)])
    return ((grams * _MUL) >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)


def _counts(rows: DataFrame) -> DataFrame:
    """``rows``: c1 (text), good (boolean).  ``bucket``, ``raw``, ``target``."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = [np.zeros(BUCKETS, dtype=np.int64), np.zeros(BUCKETS, dtype=np.int64)]
        held, size = ([], []), 0

        def flush():
            for total, parts in zip(sums, held):
                if parts:
                    total += np.bincount(np.concatenate(parts), minlength=BUCKETS)
                    parts.clear()

        for pdf in batches:
            for text, good in zip(pdf["c1"], pdf["good"]):
                grams = ngram_buckets(text)
                for parts in held if good else held[:1]:
                    parts.append(grams)
                size += len(grams)
                if size > 1 << 20:
                    flush()
                    size = 0
        flush()
        raw, target = sums
        some = np.flatnonzero(raw)
        yield pd.DataFrame({"bucket": some, "raw": raw[some], "target": target[some]})

    return (rows.select("c1", "good").mapInPandas(count, "bucket int, raw bigint, target bigint")
            .groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")))


def importance(df: DataFrame, id_col: str, text_col: str, labels: DataFrame, label_id: str,
               label_col: str, keep_share: float | None = None, seed: int = SEED) -> DataFrame:
    """One row per input row: ``id_col``, ``text_hash``, ``log_weight``,
    ``sample_key``, ``kept``.  ``keep_share``: share of documents to draw;
    None: the upper 95 % bound of the share of good rows, as the labelled ones
    tell it (rather a bad document too many than a good one too few)."""
    spark = df.sparkSession
    rows = keyed(df, id_col, text_col)
    lab = (keyed(labels, label_id, label_col).where("c0 is not null and c1 is not null")
           .groupBy(F.col("c0").alias("id")).agg(F.min("c1").alias("label")))
    good = lab.where("label = 1").select("id").orderBy(F.xxhash64("id"), "id").limit(TARGET_ROWS)
    flagged = (rows.join(F.broadcast(good), F.col("c0") == F.col("id"), "left")
               .select("c1", F.col("id").isNotNull().alias("good")))
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in _counts(flagged).collect():       # at most BUCKETS rows
        raw[r["bucket"]], target[r["bucket"]] = r["raw"], r["target"]
    if not target.any():
        target = raw
    # smoothing in proportion to each corpus, so that unseen buckets cancel
    weight = (np.log((target + SMOOTHING) / (target.sum() + SMOOTHING * BUCKETS))
              - np.log((raw + SMOOTHING) / (raw.sum() + SMOOTHING * BUCKETS)))
    shared = spark.sparkContext.broadcast(weight)

    @F.pandas_udf("double")
    def log_weight(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        w = shared.value
        for s in batches:
            yield pd.Series([float(w[ngram_buckets(t)].sum()) for t in s], dtype="float64")

    gumbel = -F.log(-F.log(uniform_open(F.col("c0"), F.col("h"), seed=seed)))
    scored = saved(rows.select("c0", F.xxhash64("c1").alias("h"), log_weight("c1").alias("log_weight"))
                   .withColumn("sample_key", F.col("log_weight") + gumbel), "importance")
    if keep_share is None:
        share, n = lab.agg(F.avg((F.col("label") == 1).cast("double")), F.count("*")).first()
        keep_share = 1.0 if share is None else min(1.0, share + 1.96 * (share * (1 - share) / n) ** 0.5)
    k = round(keep_share * scored.count())
    cut = kth_largest(scored, "sample_key", k) if k else None
    kept = F.lit(False) if cut is None else grid_value(F.col("sample_key")) >= F.lit(cut)
    return scored.select(F.col("c0").alias(id_col), F.col("h").alias("text_hash"), "log_weight", "sample_key", kept.alias("kept"))
