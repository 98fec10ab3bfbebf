"""Queries of the near-duplicate operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from rungkit.llm import embed_dedup, simhash, suffix_dedup
from rungkit.llm.common import query, read


@query("op8_simhash")
def op8_simhash(spark, sf_dir):
    out = simhash.near_duplicates(read(spark, sf_dir, "documents"), "doc_id", "text", shingle=3, max_bits=3)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


_OP10_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE len(embedding) > 0 AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))
    AND list_bool_or(list_transform(embedding, lambda x: x <> 0))),
links AS (
  SELECT a.vec_id AS u, b.vec_id AS w FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
    AND list_cosine_similarity(a.e, b.e) >= 0.9),
reach AS (SELECT u, w FROM links UNION SELECT r.u, l.w FROM reach r JOIN links l ON r.w = l.u),
n AS (SELECT u, count(*) AS n FROM links GROUP BY u),
c AS (SELECT u, least(u, min(w)) AS c FROM reach GROUP BY u)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, coalesce(c, vec_id) AS component_id,
       coalesce(c, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN n ON n.u = vec_id LEFT JOIN c ON c.u = vec_id"""


@query("op10_embedding_dedup", _OP10_SQL)
def op10_embedding_dedup(spark, sf_dir):
    out = embed_dedup.near_duplicates(read(spark, sf_dir, "embeddings"), "vec_id", "embedding", min_cosine=0.9)
    return out.select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))


@query("op9_suffix_dedup")
def op9_suffix_dedup(spark, sf_dir):
    out = suffix_dedup.remove_repeats(read(spark, sf_dir, "documents"), "doc_id", "text", length=400)
    return out.select("doc_id", "n_bytes", suffix_dedup.removed_bytes(F.col("spans")).alias("n_removed"),
                      F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
