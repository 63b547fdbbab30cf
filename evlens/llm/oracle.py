"""DuckDB SQL for the rows of the training-data queries that SQL can express."""

OP2 = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       -- "### role:" and a line end, the text with a backslash before what it escapes, " </turn>" and a line end
       sum(length(role) + length(regexp_replace(text, '(\\|###|</turn>)', 'x\1', 'g')) + 15)::BIGINT AS formatted_chars
FROM turns GROUP BY conv_id
"""

OP10 = r"""
WITH doc AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), word AS (
  SELECT doc_id, r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM doc
), opened AS (
  SELECT word.*, CASE WHEN i + 19 <= len(w) THEN array_to_string(w[i:i + 19], ' ') END AS seq
  FROM word JOIN doc USING (r)
), repeated AS (
  SELECT *, seq IS NOT NULL AND row_number() OVER (PARTITION BY seq ORDER BY doc_id, i) > 1 AS again FROM opened
), judged AS (
  SELECT r, word, i, bool_or(again) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone
  FROM repeated
), left_over AS (
  SELECT r, count(*) FILTER (WHERE gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone) AS kept
  FROM judged GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM doc LEFT JOIN left_over USING (r)
"""

OP12 = r"""
WITH cased AS (
  SELECT 'd' AS kind, doc_id AS id, row_number() OVER () AS r, text FROM documents
  UNION ALL SELECT 'q', item_id, row_number() OVER (), text FROM benchmark
), term AS (
  SELECT kind, id, r,
         unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                   '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t
  FROM cased
), bag AS (
  SELECT kind, id, r, t, count(*) AS tf FROM term GROUP BY ALL
), size AS (
  SELECT r, sum(tf)::BIGINT AS n FROM bag WHERE kind = 'd' GROUP BY r
), whole AS (
  SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM size
), weight AS (
  SELECT t, floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
  FROM bag, whole WHERE kind = 'd' GROUP BY t
), impact AS (
  SELECT b.id, b.r, b.t, w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms))) AS s
  FROM bag b JOIN size USING (r) JOIN weight USING (t), whole
  WHERE b.kind = 'd'
), scored AS (
  SELECT q.r AS item_row, q.id AS item_id, d.id AS doc_id, d.r, sum(q.tf * d.s)::BIGINT AS score
  FROM bag q JOIN impact d USING (t) WHERE q.kind = 'q' GROUP BY ALL HAVING sum(q.tf * d.s) > 0
)
SELECT item_id, row_number() OVER (PARTITION BY item_row ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank, doc_id, score
FROM scored
QUALIFY rank <= 20
"""
