"""DuckDB SQL that must give the same rows as the query of the same name."""

from __future__ import annotations

LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES: dict[str, str] = {
    "op2_exact_dedup": f"""
WITH d AS (SELECT doc_id, {LOWERED} AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256
FROM d JOIN g ON d.t = g.t
""",
    "op9_chat_format": r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
),
s AS (
  SELECT *, coalesce(lag(role) OVER w, 'start') AS before, row_number() OVER r AS back
  FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text), r AS (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC)
),
f AS (
  SELECT *,
    (before, role) IN (('start','system'), ('start','user'), ('system','user'), ('user','assistant'), ('assistant','user')) AS step,
    4 + CASE WHEN role IN ('system', 'user', 'assistant') THEN length(role)
             ELSE 1 + length(role) + length(regexp_replace(role, '[^\\#<:]', '', 'g')) END
      + 2 + length(text) + length(regexp_replace(text, '[^\\#<:]', '', 'g')) + 8 AS chars
  FROM s
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  length(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = 'assistant'), '')) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars,
  bool_and(step) AND bool_or(back = 1 AND role = 'assistant') AS valid
FROM f GROUP BY conv_id
""",
}
