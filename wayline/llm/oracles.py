"""DuckDB SQL for the numbered queries that SQL can express."""

from __future__ import annotations

from . import queries_vectors
from .quality_rules import BLOCKED

_WORDS = "regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')"

OP2 = f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
pos AS (SELECT k, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5),
win AS (SELECT k, i, w[i] || ' ' || w[i+1] || ' ' || w[i+2] || ' ' || w[i+3] || ' ' || w[i+4] AS g FROM pos),
rep AS (SELECT k, i, count(*) OVER (PARTITION BY k, g) AS c FROM win),
cov AS (SELECT k, count(DISTINCT i + j) AS n_repeat_words FROM rep, range(5) r(j) WHERE c >= 2 GROUP BY k),
lines AS (SELECT k, unnest(string_split(text, chr(10))) AS line FROM d),
dup AS (SELECT k, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
        FROM lines WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY k),
m AS (SELECT d.doc_id, len(w)::BIGINT AS n_words,
        coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
        coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
        coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
        len(list_filter(w, lambda x: regexp_matches(x, '^[A-Z][A-Z]')))::BIGINT AS n_upper_words,
        len(list_filter(w, lambda x: lower(regexp_replace(x, '[^A-Za-z]', '', 'g')) IN {BLOCKED}))::BIGINT AS n_blocked
      FROM d LEFT JOIN dup USING (k) LEFT JOIN cov USING (k)),
f AS (SELECT *, ((n_words < 10)::BIGINT + 2 * (100 * n_repeat_words > 20 * n_words)::BIGINT
        + 4 * (10 * n_symbols > n_words)::BIGINT + 8 * (100 * n_dup_lines > 30 * n_lines)::BIGINT
        + 16 * (word_chars < 2 * n_words OR word_chars > 15 * n_words)::BIGINT
        + 32 * (100 * n_upper_words > 50 * n_words)::BIGINT + 64 * (200 * n_blocked > n_words)::BIGINT)::BIGINT AS failed_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (failed_bits & 3) <> 0 AS base_failed, failed_bits = 0 AS kept, failed_bits FROM f
"""

OP10 = """
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))
      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS k FROM s GROUP BY doc_id),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y USING (g) WHERE x.doc_id <> y.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM common JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 80 * (na.k + nb.k - c)),
reach(a, b) AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a)
SELECT d.doc_id, coalesce(k, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(m, d.doc_id))::BIGINT AS component_id
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS m FROM reach GROUP BY a) USING (doc_id)
"""

OP1 = r"""
WITH c AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
t0 AS (SELECT *, len(regexp_extract_all(text, '[\p{L}\p{N}]+|[^\s\p{L}\p{N}]')) + 4 AS tokens,
  4 + length(role) + 2 + 8 + length(text) + len(regexp_extract_all(text, '[\\#]')) + (length(text) - length(replace(text, '</turn>', ''))) // 7 AS chars,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS pos FROM c),
sys AS (SELECT conv_id, min(pos) AS spos, first(tokens ORDER BY pos) AS stok, first(chars ORDER BY pos) AS schars FROM t0 WHERE role = 'system' GROUP BY conv_id),
t1 AS (SELECT t0.*, spos, schars, greatest(1024 - 128 - coalesce(stok, 0), 256) AS room FROM t0 LEFT JOIN sys USING (conv_id)),
t2 AS (SELECT *, tokens * 2 > room AS big FROM t1),
t3 AS (SELECT *, coalesce(max(CASE WHEN NOT big THEN tokens END) OVER (PARTITION BY conv_id), 0) AS longest, sum(tokens) OVER w - tokens AS begin_at, sum(big::INT) OVER w AS n_big,
  sum(CASE WHEN big THEN 0 ELSE tokens END) OVER w - CASE WHEN big THEN 0 ELSE tokens END AS small_begin FROM t2 WINDOW w AS (PARTITION BY conv_id ORDER BY pos ROWS UNBOUNDED PRECEDING)),
t4 AS (SELECT *, CASE WHEN big THEN -1 ELSE small_begin // (room - longest + 1) END AS stride FROM t3),
t5 AS (SELECT *, pos = 1 OR stride <> lag(stride) OVER w OR n_big <> lag(n_big) OVER w AS fresh FROM t4 WINDOW w AS (PARTITION BY conv_id ORDER BY pos)),
past AS (SELECT a.conv_id, sum(b.chars) AS chars FROM t5 a JOIN t5 b ON a.conv_id = b.conv_id AND a.fresh AND b.role <> 'system' AND b.begin_at BETWEEN a.begin_at - 128 AND a.begin_at - 1 GROUP BY a.conv_id),
sysrep AS (SELECT conv_id, sum(CASE WHEN fresh AND spos < pos THEN schars ELSE 0 END) AS chars, sum(fresh::INT) AS n_windows, sum(chars) AS own FROM t5 GROUP BY conv_id)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY pos), '')) AS loss_sha256,
  (min(s.own) + min(s.chars) + coalesce(min(p.chars), 0))::BIGINT AS formatted_chars, min(s.n_windows)::BIGINT AS n_windows
FROM t0 JOIN sysrep s USING (conv_id) LEFT JOIN past p USING (conv_id) GROUP BY conv_id
"""

ORACLES = {"op1_chat_formatting": OP1, "op2_quality_rules": OP2, "op10_ngram_join": OP10, **queries_vectors.ORACLES}
