"""DuckDB SQL that gives the rows of those queries that SQL can express."""

from __future__ import annotations

EXACT_DEDUP = r"""
WITH texts AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS text FROM documents
)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, sha256(text) AS text_sha256
FROM texts WINDOW w AS (PARTITION BY text)
"""

MIXING = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15))::BIGINT AS hash
  FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5, 2, 1][(((row_number() OVER (ORDER BY encode(source) NULLS LAST)) - 1) % 3 + 1)::INT] AS weight
  FROM sized GROUP BY source
), ranked AS (
  SELECT *, source_size * 3 / weight AS full_at, row_number() OVER (ORDER BY source_size * 3 / weight, encode(source) NULLS LAST) AS place
  FROM sources
), levels AS (
  SELECT *, (sum(source_size) OVER ()::DOUBLE - 3 * coalesce(sum(source_size) OVER before, 0)::DOUBLE)
            / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0))::DOUBLE AS level
  FROM ranked WINDOW before AS (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), one AS (
  SELECT arg_min(level, place) AS level FROM levels WHERE full_at > level
), wanted AS (
  SELECT source, source_size,
         CASE WHEN full_at > one.level THEN least(weight * one.level, (source_size * 3)::DOUBLE) ELSE (source_size * 3)::DOUBLE END AS target
  FROM ranked LEFT JOIN one ON true
), times AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS times FROM wanted
), running AS (
  SELECT d.*, w.source_size, w.target, w.times, w.target - w.times * w.source_size AS budget,
         sum(size) OVER (PARTITION BY d.source ORDER BY d.hash RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
         sum(size) OVER (PARTITION BY d.source, d.hash) AS here
  FROM sized d JOIN times w ON d.source IS NOT DISTINCT FROM w.source
)
SELECT doc_id, size, source_size, target,
       (size * (times + CASE WHEN budget > 0 AND (upto <= budget OR upto - here <= budget AND upto - budget < budget - (upto - here))
                             THEN 1 ELSE 0 END))::BIGINT AS taken
FROM running
"""

TOPK = r"""
WITH rows AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS w
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.w, c.w), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM rows q JOIN rows c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score
FROM scored QUALIFY rank <= 10
"""

CHAT = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(14 + length(regexp_replace(role, '([\\#<:])', '\\\1', 'g')) + length(regexp_replace(text, '([\\#<:])', '\\\1', 'g'))) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id
"""
