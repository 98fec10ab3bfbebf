"""Queries of the tokenizer operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from rungkit.llm import bpe_stream
from rungkit.llm.bpe import load_vocabulary, round_trip, token_count
from rungkit.llm.common import query, read
from rungkit.llm.token_counts import Counter, token_counts

MAX_TOKENS = 512


@query("op1_byte_bpe")
def op1_byte_bpe(spark, sf_dir):
    import public_tokenizers as p
    vocab = load_vocabulary(p.path("byte_bpe_multi_50k.tiktoken"), p.PATTERN)
    out = round_trip(read(spark, sf_dir, "documents"), "doc_id", "text", vocab)
    return out.select("doc_id", token_count(F.col("ids")).alias("n_tokens"),
                      F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op3_token_counts")
def op3_token_counts(spark, sf_dir):
    import public_tokenizers as p
    out = token_counts(read(spark, sf_dir, "documents"), "doc_id", "text", Counter(p.path("byte_bpe_50k.json")))
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > MAX_TOKENS).alias("over_limit"))


@query("op12_bpe_stream")
def op12_bpe_stream(spark, sf_dir):
    import public_tokenizers as p
    vocab = bpe_stream.load_word_vocabulary(p.path("word_bpe_49k.json"))
    out = bpe_stream.round_trip(read(spark, sf_dir, "documents"), "doc_id", "text", vocab)
    return out.select("doc_id", token_count(F.col("ids")).alias("n_tokens"),
                      F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "utf-8"), 256).alias("decoded_sha256"))
