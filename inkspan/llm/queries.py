"""Queries of the corpus operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from inkspan.llm.decontamination import op5_decontamination
from inkspan.llm.embeddings import op3_embeddings
from inkspan.llm.language import op8_language
from inkspan.llm.linededup import op9_linededup
from inkspan.llm.mixing import op11_mixing
from inkspan.llm.packing import op10_packing
from inkspan.llm.quality import op4_quality
from inkspan.llm.secretscan import op7_secretscan
from inkspan.llm.sharding import op1_sharding
from inkspan.llm.simhash import op6_simhash
from inkspan.llm.toxicity import op2_toxicity
from inkspan.llm.turns import op13_turns
from inkspan.llm.whitening import op12_whitening

QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_toxicity": op2_toxicity,
    "op3_embeddings": op3_embeddings,
    "op4_quality": op4_quality,
    "op5_decontamination": op5_decontamination,
    "op6_simhash": op6_simhash,
    "op7_secretscan": op7_secretscan,
    "op8_language": op8_language,
    "op9_linededup": op9_linededup,
    "op10_packing": op10_packing,
    "op11_mixing": op11_mixing,
    "op12_whitening": op12_whitening,
    "op13_turns": op13_turns,
}

#: CRC-32 by its table, made from the polynomial; the same ranks as the operator.
_OP1 = """WITH steps AS (SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
bytes AS (SELECT doc_id, source, coalesce(text, '') AS text, hex(encode(coalesce(text, ''))) AS h FROM documents),
sums AS (SELECT doc_id, source, octet_length(encode(text)) + 1 AS size, xor(list_reduce(list_prepend(4294967295, list_transform(range(CAST(length(h) // 2 AS BIGINT)), lambda k: CAST('0x' || substr(h, 2 * k + 1, 2) AS BIGINT))), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) AS text_crc32, substr(md5('17:' || text), 1, 16) AS mixed FROM bytes, steps),
ranked AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY mixed, doc_id, text_crc32, size) AS k, count(*) OVER (PARTITION BY source) AS n FROM sums),
placed AS (SELECT *, row_number() OVER (ORDER BY (2 * k - 1) / (2 * n), source, k) - 1 AS position, count(*) OVER () AS total FROM ranked),
cut AS (SELECT *, position * 8 // total AS s FROM placed)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'rows' AS law, CAST(s AS INT) AS shard, CAST(position - (s * total + 7) // 8 AS BIGINT) AS slot, CAST(NULL AS INT) AS grown_shard, source FROM cut"""

#: All pairs of a label and their transitive closure.
_OP3 = """WITH RECURSIVE sound AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS u, b.vec_id AS v FROM sound a JOIN sound b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach AS (SELECT vec_id AS u, vec_id AS v FROM embeddings UNION SELECT r.u, l.v FROM reach r JOIN links l ON r.v = l.u)
SELECT e.vec_id, coalesce(n, 0) AS n_links, component_id, e.vec_id = component_id AS kept FROM embeddings e LEFT JOIN (SELECT u, count(*) AS n FROM links GROUP BY u) k ON k.u = e.vec_id LEFT JOIN (SELECT u, min(v) AS component_id FROM reach GROUP BY u) c ON c.u = e.vec_id"""

#: The same damage; one recursion a row over whole conversations, which writes the repaired text as it goes.
_OP13 = r"""WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
named AS (SELECT coalesce('c' || conv_id, '-') AS conv, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, hex(encode(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '))) AS h FROM conversations),
dealt AS (SELECT *, xor(list_reduce(list_prepend(4294967295, list_transform(range(CAST(length(h) // 2 AS BIGINT)), lambda k: CAST('0x' || substr(h, 2 * k + 1, 2) AS BIGINT))), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) % 20 AS d FROM named, crc),
rows_ AS (SELECT conv, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role, CASE d WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text FROM dealt, range(CASE d WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)),
placed AS (SELECT *, left(role, 1) AS r, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, text) AS i FROM rows_),
marked AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b' WHEN row_number() OVER (PARTITION BY conv, role, text ORDER BY i) > 1 THEN 'd' WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 't' ELSE '' END AS fault, lag(r) OVER (PARTITION BY conv ORDER BY i) AS before FROM placed),
steps(p, r, q) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2), (0, 'D', 0), (1, 'D', 1), (2, 'D', 2), (3, 'D', 3)),
fills(p, m, price, letters, lines) AS (VALUES (0, 0, 0, '', ''), (1, 1, 0, '', ''), (2, 2, 0, '', ''), (3, 3, 0, '', ''), (0, 2, 3, 'I', 'user:' || chr(10)), (1, 2, 3, 'I', 'user:' || chr(10)), (3, 2, 3, 'I', 'user:' || chr(10)), (2, 3, 3, 'I', 'assistant:' || chr(10)), (0, 3, 6, 'II', 'user:' || chr(10) || 'assistant:' || chr(10)), (1, 3, 6, 'II', 'user:' || chr(10) || 'assistant:' || chr(10)), (3, 3, 6, 'II', 'user:' || chr(10) || 'assistant:' || chr(10)), (2, 2, 6, 'II', 'assistant:' || chr(10) || 'user:' || chr(10))),
least AS (SELECT DISTINCT conv, CAST(0 AS BIGINT) AS i, 0 AS p, {'cost': CAST(0 AS BIGINT), 'audit': '', 'body': ''} AS b FROM marked
UNION ALL SELECT least.conv, least.i + 1, s.q, min({'cost': b.cost + f.price + CASE e WHEN 'D' THEN 4 WHEN 'R' THEN 3 ELSE 0 END + CASE WHEN m.fault = 't' AND e <> 'D' THEN 3 ELSE 0 END, 'audit': b.audit || f.letters || e, 'body': b.body || f.lines || CASE e WHEN 'D' THEN '' WHEN 'K' THEN m.role || ':' || m.text || chr(10) ELSE CASE s.r WHEN 'u' THEN 'user' ELSE 'assistant' END || ':' || m.text || chr(10) END})
FROM least JOIN marked m ON m.conv = least.conv AND m.i = least.i + 1 JOIN fills f ON f.p = least.p JOIN steps s ON s.p = f.m, (VALUES ('D'), ('K'), ('R')) edits(e)
WHERE (e = 'D' AND s.r = 'D') OR (m.fault NOT IN ('b', 'd') AND ((e = 'K' AND s.r = m.r) OR (e = 'R' AND s.r IN ('u', 'a')))) GROUP BY least.conv, least.i, s.q),
facts AS (SELECT conv, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (before || r NOT IN ('su', 'ua', 'au')) AS illegal FROM marked GROUP BY conv),
chosen AS (SELECT conv, min({'cost': b.cost + f.price, 'audit': b.audit || f.letters, 'body': b.body || f.lines}) AS b FROM least JOIN facts USING (conv) JOIN fills f ON f.p = least.p WHERE i = n AND (f.m = 3 OR (f.m = 0 AND least.p = 0)) GROUP BY conv)
SELECT conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(b.cost, 0) AS BIGINT) AS cost, coalesce(b.audit, '') AS audit, sha256(CASE WHEN coalesce(b.body, '') = '' THEN '' ELSE left(b.body, length(b.body) - 1) END) AS repaired_sha256
FROM (SELECT DISTINCT conv, conv_id FROM named) LEFT JOIN facts USING (conv) LEFT JOIN chosen USING (conv)"""

ORACLE_SQL: dict[str, str] = {"op1_sharding": _OP1, "op3_embeddings": _OP3, "op13_turns": _OP13}
