"""Training-corpus pipeline: filter, deduplicate, mix, tokenize.

Each stage takes (spark, docs, sf_dir), works on all rows of ``docs`` and
returns a table with the columns of ``documents`` (the last one: tokens).
Decisions are made per (id, text) and joined back, so rows with a null or
repeated id are handled like any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rungkit.llm import bpe, mixing, quality, simhash, suffix_dedup
from rungkit.llm.common import read, saved, ship_package

SHINGLE_WORDS, MAX_BITS = 3, 3
REPEAT_BYTES = 400
MIX_EXPONENT, MIX_MAX_RATE = 0.9, 3.0
_KEY, _HASH = "__key_id", "__key_text"


def _decided(docs: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """``docs`` joined to decisions keyed by (_KEY id, _HASH text hash)."""
    same = docs["doc_id"].eqNullSafe(keys[_KEY]) & (F.xxhash64(docs["text"]) == keys[_HASH])
    return docs.join(keys, same, how)


def filter_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Importance resampling; the documents it does not draw go.  Null and empty
    texts weigh nothing and are drawn like any other; rows with one id and text
    stay or go together, rows that tie with the last one drawn stay; without a
    label all stay."""
    ship_package(spark)
    out = quality.importance(docs, "doc_id", "text", read(spark, sf_dir, "labels"), "doc_id", "quality")
    keep = out.where("kept").select(F.col("doc_id").alias(_KEY), F.col("text_hash").alias(_HASH)).distinct()
    return _decided(docs, keep, "left_semi")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group stays: the one with the smallest id
    (without ids, the smallest text hash)."""
    ship_package(spark)
    rows = simhash.near_duplicates(docs, "doc_id", "text", SHINGLE_WORDS, MAX_BITS)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", F.col("text_hash"))).alias("m")
    keep = saved(rows.groupBy("group").agg(first, F.count("*").alias("n"))
                 .select(F.col("m.doc_id").alias(_KEY), F.col("m.text_hash").alias(_HASH)), "survivors")
    left = _decided(docs, keep, "left_semi")
    # whole rows given twice share id and text; drop the second ones only where there are any
    twice = rows.groupBy("doc_id", "text_hash").count().where("count > 1").limit(1).count()
    if not twice:
        return left
    return (left.withColumn(_HASH, F.xxhash64("text")).dropDuplicates(["doc_id", _HASH]).drop(_HASH))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated strings are cut out of the texts (a character that is cut in
    two goes whole); every document stays, n_chars follows its text.  Null texts
    stay null, texts of fewer than REPEAT_BYTES bytes stay as they are, copies
    lose all of theirs, and texts of any length are taken whole."""
    ship_package(spark)
    out = suffix_dedup.rewrite(docs, "text", REPEAT_BYTES)
    return out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("bigint"))
                          .otherwise(F.col("n_chars"))).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are brought to tempered weights by repeating documents of the
    rarer ones; every document stays at least once and comes MIX_MAX_RATE times
    at most.  Empty and null texts stay once; equal rows get equal numbers of
    copies each."""
    ship_package(spark)
    rates, _ = mixing.fit_rates(docs, "doc_id", "text", "source", exponent=MIX_EXPONENT, min_rate=1.0, max_rate=MIX_MAX_RATE)
    key = [F.col("doc_id"), F.col("text_hash")]
    times = (rates.select(F.col("doc_id").alias(_KEY), F.col("text_hash").alias(_HASH), F.col("domain").alias("__domain"),
                          F.when(F.col("tokens") > 0, mixing.copies(F.col("rate"), *key)).otherwise(F.lit(1)).cast("bigint").alias("__copies")).distinct())
    same = (docs["doc_id"].eqNullSafe(times[_KEY]) & (F.xxhash64(docs["text"]) == times[_HASH])
            & docs["source"].eqNullSafe(times["__domain"]))
    return (docs.join(times, same).withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("__copies"))))
            .select(*docs.columns))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document (packed, see :mod:`rungkit.llm.bpe`), and
    whether they decode to its text; a null text is empty, repeated rows give
    repeated results, texts of any length are encoded whole."""
    ship_package(spark)
    import public_tokenizers as p
    vocab = bpe.load_vocabulary(p.path("byte_bpe_multi_50k.tiktoken"), p.PATTERN)
    return bpe.checked_ids(docs, "doc_id", "text", vocab)


STAGES = [
    ("quality", filter_quality),
    ("near_duplicates", drop_near_duplicates),
    ("repeats", cut_repeats),
    ("mixing", mix_sources),
    ("tokens", tokenize),
]

#: learned models and iterative fits have no SQL form; tests hold the stages
#: against brute-force versions
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
