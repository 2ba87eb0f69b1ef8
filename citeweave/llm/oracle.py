"""DuckDB twins of the queries that SQL can express over whole tables."""

from __future__ import annotations

# Words are the runs of [^\x20\x09-\x0D]; windows and lines are compared as strings.
_OP5 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
p AS (SELECT doc_id, i, array_to_string(words[i:i + 4], ' ') AS win
      FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM w)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS n FROM p) WHERE n > 1),
c AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, i + k AS j FROM r, range(5) AS x(k)) GROUP BY doc_id),
m AS (SELECT w.doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
             len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, len(lines) AS n_lines,
             len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words,
             len(list_filter(words, lambda x: list_contains([{stop}], lower(x)))) AS n_stop,
             len(list_filter(lines, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) AS n_ellipsis,
             len(list_filter(lines, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*•‣·]'))) AS n_bullets
      FROM w LEFT JOIN c USING (doc_id)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
       NOT base_failed AND word_chars / n_words BETWEEN 2 AND 20 AND n_symbols / n_words <= 0.1
       AND (n_stop + 1) / n_words >= 0.02 AND n_dup_lines / greatest(n_lines, 1) <= 0.4
       AND n_ellipsis / greatest(n_lines, 1) <= 0.3 AND n_bullets / greatest(n_lines, 1) <= 0.9 AS kept
FROM b
"""
_STOP = ("the of and to in is that for with was on as by it are be le la les de des et un une en que qui du est pour "
         "dans par der die das und zu den von mit ist im ein eine auf nicht el los las y se su con para no lo al del")

_OP1 = r"""
WITH t AS (SELECT conv_id, turn, role, text FROM conversations
           UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
n AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM t),
o AS (SELECT conv_id, count(*) AS n_turns,
             string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
             coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss,
             sum(length('<|turn|><|text|><|end|>') + length(role || text)
                 + length(regexp_replace(role || text, '[^<[]', '', 'g')))::BIGINT AS formatted_chars
      FROM n GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
       formatted_chars FROM o
"""

_OP2 = r"""
WITH RECURSIVE
w AS MATERIALIZED (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
      'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS s
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM w WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
l AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b FROM g AS a JOIN g AS b ON a.s = b.s AND a.doc_id <> b.doc_id
      JOIN n AS na ON na.doc_id = a.doc_id JOIN n AS nb ON nb.doc_id = b.doc_id
      GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= 90 * (na.n + nb.n - count(*))),
r(a, b) AS (SELECT doc_id, doc_id FROM w UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, (SELECT min(b) FROM r WHERE r.a = w.doc_id) AS component_id
FROM w LEFT JOIN n USING (doc_id)
"""

_OP3 = r"""
WITH f(doc, id, t) AS (SELECT true, doc_id::VARCHAR, text FROM documents UNION ALL SELECT false, item_id::VARCHAR, text FROM benchmark),
g AS (SELECT doc, id, list_filter(regexp_split_to_array(translate(coalesce(t, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
             'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM f),
p AS (SELECT DISTINCT id AS item, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS win
      FROM (SELECT id, w, unnest(range(1, greatest(len(w) - 8, 2))) AS i FROM g WHERE NOT doc AND len(w) > 0)),
s AS (SELECT id, i, n, array_to_string(w[i:i + n - 1], ' ') AS win
      FROM (SELECT id, w, unnest(range(1, len(w) + 1)) AS i FROM g WHERE doc), (SELECT DISTINCT n FROM p)
      WHERE i + n - 1 <= len(w)),
o AS (SELECT s.id, s.i, s.n, p.item FROM s JOIN p ON s.n = p.n AND s.win = p.win),
h AS (SELECT id, count(DISTINCT j) AS n FROM (SELECT id, unnest(range(i, i + n)) AS j FROM o) GROUP BY id),
q AS (SELECT id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT id, item FROM o) GROUP BY id)
SELECT g.id::BIGINT AS doc_id, len(w)::BIGINT AS n_words, coalesce(h.n, 0)::BIGINT AS n_hit, coalesce(q.n, 0)::BIGINT AS n_items,
       sha256(coalesce(q.items, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
FROM g LEFT JOIN h ON h.id = g.id LEFT JOIN q ON q.id = g.id WHERE doc
"""

# Unsigned CRC-32 of an ASCII string, by the table of its polynomial (a single row "crc_table", column t).
_CRC_TABLE = """
crc_table AS (SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: xor(c >> 1, CASE WHEN c % 2 = 1 THEN 3988292384 ELSE 0 END))
                          ORDER BY i) AS t FROM range(256) AS r(i))"""


def _crc(s: str) -> str:
    return (f"xor(list_reduce(list_prepend(4294967295, list_transform(string_split({s}, ''), lambda x: ascii(x)::BIGINT)), "
            "lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)")


def _field(c: str) -> str:
    return f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR) || ':' || {c} END"


def _row(text: str) -> str:
    return "sha256(" + " || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


def _levels(name: str, leaves: str) -> str:
    """Nodes of all levels, and for each node that has a parent the digests left and right of it in its run."""
    return f"""
{name}(tree, level, idx, d, size) AS (SELECT tree, 0, idx, d, size FROM {leaves} UNION ALL
  SELECT tree, level + 1, idx // 16, sha256(string_agg(d, '' ORDER BY idx)), (size + 15) // 16 FROM {name}
  WHERE size > 1 GROUP BY tree, level, idx // 16, size),
{name}_beside AS (SELECT a.tree, a.level, a.idx, coalesce(string_agg(b.d, '' ORDER BY b.idx) FILTER (b.idx < a.idx), '') AS l,
    coalesce(string_agg(b.d, '' ORDER BY b.idx) FILTER (b.idx > a.idx), '') AS r
  FROM {name} AS a JOIN {name} AS b ON a.tree = b.tree AND a.level = b.level AND a.idx // 16 = b.idx // 16
  WHERE a.size > 1 GROUP BY a.tree, a.level, a.idx)"""


_OP13 = f"""
WITH RECURSIVE {_CRC_TABLE},
x AS (SELECT *, CASE WHEN {_crc("doc_id::VARCHAR")} % 5 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')
             ELSE text END AS copy FROM documents, crc_table),
h AS (SELECT doc_id, coalesce('s' || source, '') AS tree, {_row("text")} AS d, {_row("copy")} AS claim FROM x),
leaves AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, d) - 1 AS idx,
                  count(*) OVER (PARTITION BY tree) AS size FROM h),{_levels("n", "leaves")},
subroots AS (SELECT '' AS tree, tree AS source, d, row_number() OVER (ORDER BY tree) - 1 AS idx, count(*) OVER () AS size
             FROM n WHERE size = 1),{_levels("top", "subroots")},
steps AS (SELECT l.tree, l.idx, b.level, b.l, b.r FROM leaves AS l JOIN n_beside AS b ON b.tree = l.tree AND b.idx = l.idx >> (4 * b.level)
          UNION ALL SELECT l.tree, l.idx, 1000 + b.level, b.l, b.r FROM leaves AS l JOIN subroots AS s ON s.source = l.tree
          JOIN top_beside AS b ON b.idx = s.idx >> (4 * b.level)),
proofs AS (SELECT tree, idx, string_agg(l || r, '' ORDER BY level) AS proof, list(l || '|' || r ORDER BY level) AS pairs
           FROM steps GROUP BY tree, idx),
found AS (SELECT doc_id, l.d AS leaf, s.d AS subroot, (SELECT d FROM top WHERE size = 1) AS root,
                 sha256(coalesce(proof, '')) AS proof_sha256,
                 list_reduce(list_prepend(claim, coalesce(pairs, [])),
                             lambda a, p: sha256(split_part(p, '|', 1) || a || split_part(p, '|', 2))) AS folded_root
          FROM leaves AS l JOIN subroots AS s ON s.source = l.tree LEFT JOIN proofs AS p ON p.tree = l.tree AND p.idx = l.idx)
SELECT *, folded_root = root AS verified FROM found
"""

_OP12 = f"""
WITH RECURSIVE {_CRC_TABLE},
c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
             coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS mark FROM conversations),
k AS (SELECT conv_id, turn, role, text, {_crc("mark")} % 20 AS k FROM c, crc_table),
d AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role,
             CASE WHEN k = 1 THEN '' WHEN k = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
             unnest(range(CASE WHEN k = 3 THEN 2 ELSE 1 END)) AS copy FROM k WHERE k <> 0),
h AS (SELECT *, sha256(length(role) || ':' || role || text) AS h, regexp_extract(text, '([^\\x20\\x09-\\x0D])[\\x20\\x09-\\x0D]*$', 1) AS ending FROM d),
f AS (SELECT *, CASE WHEN ending = '' THEN 'blank'
                     WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 THEN 'duplicate'
                     WHEN ending NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM h),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, h, copy) AS i,
             lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, h, copy) AS before FROM f),
ins(p, q) AS (VALUES ('E', 'U'), ('S', 'U'), ('A', 'U'), ('U', 'A')),
one(p, q, need, letter, cost) AS (SELECT p, p, NULL::VARCHAR, 'D', 3 FROM (VALUES ('E'), ('S'), ('U'), ('A')) AS x(p)
  UNION ALL SELECT p, q, CASE q WHEN 'U' THEN 'u' ELSE 'a' END, 'K', 0 FROM ins UNION ALL SELECT 'E', 'S', 's', 'K', 0
  UNION ALL SELECT p, q, NULL::VARCHAR, 'R', 2 FROM ins),
opt AS (SELECT p, q, need, letter, letter AS letters, cost, NULL::VARCHAR AS added FROM one
  UNION ALL SELECT ins.p, one.q, need, letter, 'I' || letter, cost + 2, ins.q FROM ins JOIN one ON one.p = ins.q),
dp(conv_id, i, st, cost, audit, rep) AS (
  SELECT conv_id, 0::BIGINT, 'E', 0, '', []::VARCHAR[] FROM (SELECT DISTINCT conv_id FROM c) UNION ALL
  SELECT * EXCLUDE best FROM (
    SELECT dp.conv_id, r.i, o.q, dp.cost + o.cost + CASE WHEN fault = 'truncated' AND letter <> 'D' THEN 1 ELSE 0 END AS cost,
           audit || letters AS audit,
           rep || CASE added WHEN 'U' THEN ['user:'] WHEN 'A' THEN ['assistant:'] ELSE [] END
               || CASE letter WHEN 'D' THEN [] WHEN 'K' THEN [role || ':' || text]
                  ELSE [CASE o.q WHEN 'U' THEN 'user:' ELSE 'assistant:' END || text] END,
           row_number() OVER (PARTITION BY dp.conv_id, o.q
                              ORDER BY dp.cost + o.cost + CASE WHEN fault = 'truncated' AND letter <> 'D' THEN 1 ELSE 0 END, audit || letters) AS best
    FROM dp JOIN r ON r.conv_id IS NOT DISTINCT FROM dp.conv_id AND r.i = dp.i + 1 JOIN opt AS o ON o.p = dp.st
    WHERE (need IS NULL OR need = left(role, 1)) AND (letter = 'D' OR fault NOT IN ('blank', 'duplicate'))) WHERE best = 1),
ends AS (SELECT conv_id, i, cost + CASE st WHEN 'U' THEN 2 ELSE 0 END AS cost, audit || CASE st WHEN 'U' THEN 'I' ELSE '' END AS audit,
                rep || CASE st WHEN 'U' THEN ['assistant:'] ELSE [] END AS rep FROM dp WHERE st <> 'S'),
stats AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
                 count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
                 count(*) FILTER (fault = 'truncated') AS truncated,
                 count(*) FILTER (i > 1 AND before || left(role, 1) NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY conv_id)
SELECT e.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, cost::BIGINT AS cost, audit,
       sha256(array_to_string(rep, chr(10))) AS repaired_sha256
FROM ends AS e LEFT JOIN stats AS s ON s.conv_id IS NOT DISTINCT FROM e.conv_id WHERE e.i = coalesce(s.n, 0)
QUALIFY row_number() OVER (PARTITION BY e.conv_id ORDER BY cost, audit) = 1
"""

ORACLE = {
    "op1_chat_format": _OP1,
    "op2_ngram_join": _OP2,
    "op3_decontaminate": _OP3,
    "op12_conversation_repair": _OP12,
    "op13_merkle_manifest": _OP13,
    "op5_quality_rules": _OP5.replace("{stop}", ", ".join(f"'{w}'" for w in _STOP.split())),
}
