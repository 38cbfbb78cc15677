"""The registered queries of the training-data operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from hearthmark.llm.bpe import op1_byte_bpe
from hearthmark.llm.chat import OP3_SQL, op3_preferences
from hearthmark.llm.fingerprint import op2_fingerprint
from hearthmark.llm.html import op6_html
from hearthmark.llm.language import op9_language
from hearthmark.llm.mixing import op7_mixing
from hearthmark.llm.negatives import op13_hard_negatives
from hearthmark.llm.neighbours import op10_neighbours
from hearthmark.llm.pstable import op12_embedding_dups
from hearthmark.llm.quality import op4_quality
from hearthmark.llm.simhash import op8_simhash
from hearthmark.llm.tokenid import op5_token_ids
from hearthmark.llm.whitening import op11_whitening

OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS place,
    coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size FROM documents
), s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rk FROM s),
v AS (SELECT *, CASE rk % 3 WHEN 0 THEN CAST(5 AS DOUBLE) WHEN 1 THEN CAST(2 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS weight, CAST(2 AS DOUBLE) * source_size AS cap FROM w),
x AS (SELECT *, cap / weight AS stop FROM v),
y AS (
  SELECT *, (CAST(1.5 AS DOUBLE) * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY stop, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY stop, rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM x
), z AS (SELECT level FROM y WHERE level <= stop ORDER BY stop, rk LIMIT 1),
t AS (SELECT y.source, y.source_size, y.rk, least(y.cap, coalesce((SELECT level FROM z), CAST('inf' AS DOUBLE)) * y.weight) AS target FROM y),
p AS (
  SELECT d.doc_id, d.size, t.source_size, t.rk, t.target,
    sum(d.size) OVER (PARTITION BY d.source ORDER BY d.place, d.doc_id NULLS FIRST, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - d.size AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), q AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(floor(target) / source_size) AS BIGINT) ELSE 0 END AS rounds FROM p
), r AS (
  SELECT *, CAST(rounds * size + least(size, greatest(0, CAST(floor(target) AS BIGINT) - rounds * source_size - before)) AS BIGINT) AS taken,
    least(CAST(1 AS DOUBLE), CAST(before AS DOUBLE) / greatest(target, 1)) AS share,
    CASE rk % 3 WHEN 0 THEN CAST(-0.5 AS DOUBLE) WHEN 1 THEN CAST(0 AS DOUBLE) ELSE CAST(0.5 AS DOUBLE) END AS tilt FROM q
)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, taken,
  CASE WHEN taken = 0 THEN NULL WHEN tilt = 0 THEN share
    ELSE (sqrt(greatest(CAST(0 AS DOUBLE), (1 - tilt) * (1 - tilt) + 4 * tilt * share)) - (1 - tilt)) / (2 * tilt) END AS position
FROM r
"""

QUERIES = {f.__name__: f for f in (op1_byte_bpe, op2_fingerprint, op3_preferences, op4_quality, op5_token_ids, op6_html, op7_mixing, op8_simhash, op9_language, op10_neighbours, op11_whitening, op12_embedding_dups, op13_hard_negatives)}
ORACLES = {"op3_preferences": OP3_SQL, "op7_mixing": OP7_SQL}
