"""Queries of the classifiers: quality, language, toxicity."""

from __future__ import annotations

from pyspark.sql import functions as F

from rungkit.llm import language, quality, toxicity
from rungkit.llm.common import held_out, query, read

TOXIC_FROM = 0.3


@query("op4_quality")
def op4_quality(spark, sf_dir):
    out = quality.importance(read(spark, sf_dir, "documents"), "doc_id", "text",
                             read(spark, sf_dir, "labels"), "doc_id", "quality")
    return out.select("doc_id", "log_weight", "sample_key", "kept")


@query("op5_language")
def op5_language(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    langs, prototypes = language.fit(docs, "doc_id", "text", "lang")
    out = language.predict(docs, "doc_id", "text", langs, prototypes)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


@query("op6_toxicity")
def op6_toxicity(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    model = toxicity.fit(docs, "doc_id", "text", read(spark, sf_dir, "labels"), "doc_id", "toxic")
    out = toxicity.score(docs, "doc_id", "text", model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                      (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"))
