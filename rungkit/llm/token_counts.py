"""Token counts through a digest cache.

A text's content digest (SHA-256 of its UTF-8 bytes; null is normalised to
the empty text, nothing else is changed because anything else could change
the count) and the tokenizer's version digest (SHA-256 of its file and of
the counting rules) key a stored table of counts.  Texts whose digest is in
the table are answered by the join; of the others every distinct text is
encoded once and its count appended.

Edge cases: null and empty text count 0 tokens and 0 bytes; repeated rows
each get their row, encoded once; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rungkit.llm.bpe import memoized, split_chunks
from rungkit.llm.common import keyed, saved
from rungkit.session import scratch_path

RULES = "no added specials;special strings by the library's default;no truncation;no padding"
CACHE_SCHEMA = "tokenizer string, digest string, n_tokens bigint"
#: tasks over which copies of one text are dealt when they get its count
SALTS = 8


class Counter:
    """Counts the tokens of texts with the library of a tokenizer file.  The
    file's bytes are carried along, so executors need no local copy."""

    def __init__(self, path: str):
        self.kind = path.rsplit(".", 1)[-1]
        with open(path, "rb") as f:
            self.blob = f.read()
        self.version = hashlib.sha256(self.blob + RULES.encode() + self.kind.encode()).hexdigest()
        self._library = None
        self._memo: dict[str, int] = {}
        self._cut = self.kind == "json" and _cuts_at_spaces(json.loads(self.blob))

    def __getstate__(self):
        return {**self.__dict__, "_library": None, "_memo": {}}

    def _load(self):
        if self.kind == "model":
            import sentencepiece
            self._library = sentencepiece.SentencePieceProcessor(model_proto=self.blob)
        else:
            import tokenizers
            self._library = tokenizers.Tokenizer.from_buffer(self.blob)
            self._library.no_truncation()
            self._library.no_padding()

    def _encode(self, texts: list[str]) -> list[int]:
        if self.kind == "model":
            return [len(x) for x in self._library.encode(texts, num_threads=1)]
        return [len(x) for x in self._library.encode_batch_fast(texts, add_special_tokens=False)]

    def count(self, texts: list[str]) -> list[int]:
        if self._library is None:
            import os
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            self._load()
        if not self._cut:
            return self._encode(texts)
        out = []
        for t in texts:
            parts = split_chunks(t) if t else []
            out.append(sum(map(memoized(self._memo, parts, self._encode), parts)))
        return out


def _cuts_at_spaces(spec: dict) -> bool:
    """Byte-level pre-tokenization by the usual pattern, without normaliser or
    prefix space and without added tokens that reach over spaces: then no
    token spans the cut of :func:`split_chunks`, and counts add up over chunks."""
    pre = spec.get("pre_tokenizer") or {}
    return (spec.get("normalizer") is None and pre.get("type") == "ByteLevel"
            and pre.get("use_regex", True) and not pre.get("add_prefix_space", True)
            and not any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") or t.get("normalized")
                        or any(map(str.isspace, t["content"])) for t in spec.get("added_tokens", [])))


def read_cache(spark: SparkSession, cache_path: str) -> DataFrame:
    """The stored counts (an absent path is an empty cache)."""
    p = spark._jvm.org.apache.hadoop.fs.Path(cache_path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return spark.createDataFrame([], CACHE_SCHEMA)
    return spark.read.schema(CACHE_SCHEMA).parquet(cache_path)


def token_counts(df: DataFrame, id_col: str, text_col: str, counter: Counter,
                 cache_path: str | None = None) -> DataFrame:
    """One row per input row: ``id_col``, ``digest``, ``n_bytes``, ``n_tokens``.

    ``cache_path``: folder of the stored counts, in a store all executors
    share; without one the call uses a cache of its own under
    ``spark.checkpoint.dir``.  The counts of the misses are appended in one
    committed write; a digest written twice by concurrent runs carries the
    same count and is read once.
    """
    spark = df.sparkSession
    cache_path = cache_path or scratch_path(spark, "token-count-cache")
    text = F.coalesce(F.col("c1"), F.lit(""))
    rows = keyed(df, id_col, text_col).select("c0", text.alias("text"))
    hashed = rows.withColumn("digest", F.sha2("text", 256))
    known = (read_cache(spark, cache_path).where(F.col("tokenizer") == counter.version)
             .groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")))
    # one row per digest leaves each map task, however many copies a text has
    misses = (hashed.groupBy("digest").agg(F.first("text").alias("text"))
              .join(known.select("digest"), "digest", "left_anti"))
    shared = spark.sparkContext.broadcast(counter)

    @F.pandas_udf("bigint")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        c = shared.value
        for s in batches:
            yield pd.Series(c.count(s.tolist()), dtype="int64")

    (misses.select(F.lit(counter.version).alias("tokenizer"), "digest", count("text").alias("n_tokens"))
     .write.mode("append").parquet(cache_path))
    stored = (read_cache(spark, cache_path).where(F.col("tokenizer") == counter.version)
              .groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")))
    # copies of a text are dealt over SALTS tasks, and so is its count
    salt = F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).alias("salt")
    stored = stored.select("digest", "n_tokens", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))).alias("salt"))
    return (hashed.select("c0", "digest", F.octet_length("text").cast("bigint").alias("n_bytes"), salt)
            .join(stored, ["digest", "salt"])
            .select(F.col("c0").alias(id_col), "digest", "n_bytes", "n_tokens"))
