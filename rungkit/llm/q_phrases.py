"""Query of the collocation operator."""

from __future__ import annotations

import string

from rungkit.llm.collocations import collocations, first_of_each
from rungkit.llm.common import query, read

MIN_COUNT, MOST_WORDS, TOP = 100, 5, 2000

_SQL = f"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, list_filter(string_split_regex(unnest(string_split_regex(
    translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[.,;:!?\\x0A-\\x0D]')), '[ \\x09]+'), lambda x: x <> '') AS w
  FROM documents),
total AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM p GROUP BY lang),
g AS (SELECT lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: w[i:i + m - 1])) AS ws
      FROM p, range(1, {MOST_WORDS + 1}) t(m) WHERE len(w) >= m),
f AS (SELECT lang, m, ws, count(*) AS a FROM g GROUP BY lang, m, ws HAVING count(*) >= {MIN_COUNT}),
cut AS (
  SELECT c.lang, c.m, c.ws, c.a, k, x.a AS l, y.a AS r, n,
         (CAST(1000 AS HUGEINT) * c.a * n) // (CAST(x.a AS HUGEINT) * y.a) AS score
  FROM f c JOIN range(1, {MOST_WORDS}) t(k) ON k < c.m
  JOIN f x ON x.lang = c.lang AND x.ws = c.ws[1:k] JOIN f y ON y.lang = c.lang AND y.ws = c.ws[k + 1:c.m]
  JOIN total ON total.lang = c.lang WHERE c.m > 1),
best AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, ws ORDER BY score, k) = 1),
inner_parts AS (
  SELECT lang, ws[i:i + q - 1] AS ws, max(a) AS most FROM f, range(2, {MOST_WORDS}) t(q), range(1, {MOST_WORDS}) s(i)
  WHERE q < m AND i + q - 1 <= m GROUP BY ALL),
kept AS (
  SELECT b.* FROM best b LEFT JOIN inner_parts h ON h.lang = b.lang AND h.ws = b.ws
  WHERE h.most IS NULL OR 100 * h.most < 100 * b.a),
named AS (SELECT *, array_to_string(ws, ' ') AS phrase FROM kept)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n,
       CAST(score AS BIGINT) AS score
FROM named QUALIFY rank <= {TOP}"""


@query("op11_phrases", _SQL)
def op11_phrases(spark, sf_dir):
    out = collocations(read(spark, sf_dir, "documents"), "text", "lang", least=MIN_COUNT, most_words=MOST_WORDS)
    return first_of_each(out, TOP).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
