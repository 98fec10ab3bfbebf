"""Query of the manifest operator."""

from __future__ import annotations

import string

from pyspark.sql import functions as F

from rungkit.llm.common import query, read
from rungkit.llm.merkle import leaf_digest, manifest

#: documents whose id's crc32 this divides are tampered with
TAMPER_EVERY = 3
MAX_LEVEL = 12      # of the SQL form: 8 ** 12 rows

_FIELD = "coalesce(strlen(CAST({0} AS VARCHAR)) || ':' || CAST({0} AS VARCHAR), '-')"
_ROW = " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars"))
_SHIFT = "CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END"
_CRC = f"""list_reduce(list_prepend(CAST(4294967295 AS UBIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
  lambda c: CAST(ascii(c) AS UBIGINT))), lambda a, c: list_reduce(list_prepend(xor(a, c),
  list_transform(range(8), lambda i: CAST(i AS UBIGINT))), lambda x, i: {_SHIFT}))"""

_SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, lang, xor({_CRC}, 4294967295) % {TAMPER_EVERY} = 0 AS hit,
         sha256({_ROW} || {_FIELD.format('text')}) AS leaf,
         sha256({_ROW} || {_FIELD.format(f"translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}')")}) AS low
  FROM documents),
leaves AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx FROM d),
nodes AS (
  SELECT 0 AS level, coalesce('=' || lang, '') AS g, idx, leaf AS h, count(*) OVER (PARTITION BY lang) AS n FROM leaves
  UNION ALL
  SELECT level + 1, g, idx // 8, sha256(string_agg(h, '' ORDER BY idx)), (any_value(n) + 7) // 8
  FROM nodes WHERE n > 1 GROUP BY level, g, idx // 8),
subs AS (SELECT g, h, row_number() OVER (ORDER BY g) - 1 AS idx, count(*) OVER () AS n FROM nodes WHERE n = 1),
tops AS (
  SELECT 0 AS level, idx, h, n FROM subs
  UNION ALL
  SELECT level + 1, idx // 8, sha256(string_agg(h, '' ORDER BY idx)), (any_value(n) + 7) // 8
  FROM tops WHERE n > 1 GROUP BY level, idx // 8),
height AS (SELECT g, max(level) AS top FROM nodes GROUP BY g),
tree AS (
  SELECT level, g, idx, h, n FROM nodes WHERE n > 1
  UNION ALL SELECT {MAX_LEVEL} + level, '*', idx, h, n FROM tops WHERE n > 1),
runs AS (SELECT level, g, idx // 8 AS run, list(h ORDER BY idx) AS hs FROM tree GROUP BY level, g, idx // 8),
walk AS (
  SELECT leaves.doc_id, leaves.leaf, leaves.idx AS leaf_idx, coalesce('=' || lang, '') AS own,
         0 AS level, coalesce('=' || lang, '') AS g, leaves.idx, CASE WHEN hit THEN low ELSE leaf END AS h, '' AS proof
  FROM leaves
  UNION ALL
  SELECT w.doc_id, w.leaf, w.leaf_idx, w.own,
         CASE WHEN r.hs IS NULL THEN {MAX_LEVEL} ELSE w.level + 1 END,
         CASE WHEN r.hs IS NULL THEN '*' ELSE w.g END,
         CASE WHEN r.hs IS NULL THEN s.idx ELSE w.idx // 8 END,
         CASE WHEN r.hs IS NULL THEN w.h ELSE sha256(array_to_string(r.hs[1:w.idx % 8], '') || w.h
              || array_to_string(r.hs[w.idx % 8 + 2:8], '')) END,
         CASE WHEN r.hs IS NULL THEN w.proof ELSE w.proof || array_to_string(r.hs[1:w.idx % 8], '')
              || array_to_string(r.hs[w.idx % 8 + 2:8], '') END
  FROM walk w LEFT JOIN runs r ON r.level = w.level AND r.g = w.g AND r.run = w.idx // 8
              LEFT JOIN subs s ON s.g = w.own
  WHERE r.hs IS NOT NULL OR w.g <> '*'),
ends AS (SELECT * FROM walk w WHERE g = '*' AND NOT EXISTS (SELECT 1 FROM runs r WHERE r.g = '*' AND r.level = w.level))
SELECT e.doc_id, e.leaf, s.h AS subroot, t.h AS root, sha256(e.proof) AS proof_sha256, e.h AS folded_root, e.h = t.h AS verified
FROM ends e JOIN subs s ON s.g = e.own CROSS JOIN (SELECT h FROM tops WHERE n = 1) t"""


@query("op13_merkle", _SQL)
def op13_merkle(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    head = [docs[c] for c in ("doc_id", "source", "lang", "n_chars")]
    low = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPER_EVERY == 0
    out = manifest(docs, "doc_id", "lang", leaf_digest(*head, docs["text"]),
                   F.when(hit, leaf_digest(*head, low)))
    return out.select("doc_id", "leaf", "subroot", "root", F.sha2(F.encode("proof", "utf-8"), 256).alias("proof_sha256"),
                      "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
