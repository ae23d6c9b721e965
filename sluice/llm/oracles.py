"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

OP2_LINE_DEDUP = r"""
WITH lines AS (
  SELECT doc_id, line, pos,
         translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
        FROM documents)
),
shared AS (
  SELECT k, max(doc_id) AS home FROM lines
  WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3
),
judged AS (
  SELECT l.doc_id, l.line, l.pos, (s.k IS NOT NULL AND s.home <> l.doc_id) AS gone
  FROM lines l LEFT JOIN shared s ON l.k = s.k
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""

OP1_EMBEDDING_NEAR_DEDUP = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
),
ok AS (
  SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS size FROM v
  WHERE e IS NOT NULL AND len(e) > 0
    AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(e, lambda x: x <> 0)) > 0
),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / (a.size * b.size) >= 0.95
),
reach(a, b) AS (
  SELECT vec_id, vec_id FROM v
  UNION
  SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
),
least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT v.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, least.component_id, v.vec_id = least.component_id AS kept
FROM v JOIN least ON least.a = v.vec_id LEFT JOIN n ON n.a = v.vec_id
"""

OP3_MIXING = r"""
WITH RECURSIVE sizes AS (
  SELECT source, CAST(sum(length(coalesce(text, ''))) AS BIGINT) AS size FROM documents GROUP BY source
),
weighed AS (
  SELECT source, size, CASE WHEN size > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS weight FROM sizes
),
sums AS (SELECT CAST(sum(size) AS DOUBLE) AS size, sum(weight) AS weight FROM weighed),
rates AS (
  SELECT w.source, CASE WHEN w.weight > 0 THEN w.weight / s.weight * 1.0::DOUBLE * s.size / CAST(w.size AS DOUBLE) ELSE 0.0::DOUBLE END AS rate
  FROM weighed w, sums s
),
parts AS (
  SELECT source, parts, rate / parts AS r FROM (SELECT source, rate, greatest(1, CAST(ceil(rate / 8.0::DOUBLE) AS INTEGER)) AS parts FROM rates)
),
sums_to(source, k, term, total, r) AS (
  SELECT source, 0, exp(-r), exp(-r), r FROM parts
  UNION ALL
  SELECT source, k + 1, term * r / (k + 1), total + term * r / (k + 1), r FROM sums_to WHERE k < 63
),
draws AS (
  SELECT d.doc_id, p.source, unnest(range(p.parts)) AS part FROM documents d JOIN parts p ON d.source IS NOT DISTINCT FROM p.source
),
uniforms AS (
  SELECT doc_id, source, part, CAST(CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR) || ':42:' || CAST(part AS VARCHAR)), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0::DOUBLE AS u
  FROM draws
),
counts AS (
  SELECT u.doc_id, count(*) AS n FROM uniforms u JOIN sums_to s ON u.source IS NOT DISTINCT FROM s.source AND s.total <= u.u GROUP BY u.doc_id
)
SELECT doc_id, text, lang, source, n_chars, CAST(copy AS INTEGER) AS copy,
       md5(CAST(doc_id AS VARCHAR) || ':42:order:' || CAST(copy AS VARCHAR)) AS shuffle_key
FROM (SELECT d.*, unnest(range(c.n)) AS copy FROM documents d JOIN counts c USING (doc_id))
"""

OP7_WARC = r"""
WITH p AS (
  SELECT page_id, lower(url) AS url, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
  FROM pages
),
firsts AS (SELECT payload_digest, min(page_id) AS home FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest),
parts AS (
  SELECT p.*, f.home,
         string_split(regexp_replace(regexp_extract(url, '^[a-z][a-z0-9+.-]*://([^/?#]*)', 1), '^www\.', ''), '.') AS host,
         regexp_extract(url, '^[a-z][a-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path,
         regexp_extract(url, '\?([^#]*)', 1) AS query
  FROM p LEFT JOIN firsts f ON f.payload_digest = p.payload_digest AND p.payload_bytes >= 100
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN home <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN home <> page_id THEN home END AS refers_to,
       array_to_string(list_reverse(host), ',') || ')' || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN query = '' THEN '' ELSE '?' || query END AS urlkey,
       strftime(TIMESTAMP '2020-01-01 00:00:00' + to_seconds(page_id), '%Y-%m-%dT%H:%M:%SZ') AS captured
FROM parts
"""

OP10_CHAT = r"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
),
t AS (
  SELECT conv_id, role, text, (length(text) + 3) // 4 + 4 AS tokens,
         4 + length(role) + 1 + length(text) + length(text) - length(regexp_replace(text, '[\[<\\]', '', 'g')) + 4 AS chars,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS i
  FROM said
),
room AS (
  SELECT t.*, greatest(1024 - 256 - coalesce(max(CASE WHEN i = 0 AND role = 'system' THEN tokens END) OVER (PARTITION BY conv_id), 0), 1) AS room FROM t
),
sized AS (
  SELECT *, CASE WHEN tokens * 2 > room THEN 1 ELSE 0 END AS large, CASE WHEN tokens * 2 > room THEN 0 ELSE tokens END AS small FROM room
),
summed AS (
  SELECT *, max(small) OVER (PARTITION BY conv_id) AS longest,
         sum(large) OVER (PARTITION BY conv_id ORDER BY i) AS run, sum(small) OVER (PARTITION BY conv_id ORDER BY i) AS upto
  FROM sized
),
celled AS (
  SELECT *, CASE WHEN large = 1 THEN -1 ELSE floor((upto - 1) / (room - longest)) END AS cell FROM summed
),
windows AS (SELECT conv_id, run, cell, min(i) AS f FROM celled GROUP BY conv_id, run, cell),
history AS (
  SELECT h.conv_id, h.chars, sum(h.tokens) OVER (PARTITION BY w.conv_id, w.f ORDER BY h.i DESC) AS upto
  FROM windows w JOIN celled h ON h.conv_id = w.conv_id AND h.i >= w.f - 2 AND h.i < w.f AND NOT (h.i = 0 AND h.role = 'system')
),
repeats AS (
  SELECT conv_id, chars FROM history WHERE upto <= 256
  UNION ALL
  SELECT c.conv_id, c.chars FROM celled c JOIN windows w ON w.conv_id = c.conv_id AND w.f > 0 WHERE c.i = 0 AND c.role = 'system'
),
repeated AS (SELECT conv_id, sum(chars) AS chars FROM repeats GROUP BY conv_id),
told AS (
  SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
         coalesce(string_agg(text, '' ORDER BY i) FILTER (WHERE role = 'assistant'), '') AS learnt, sum(chars) AS chars
  FROM t GROUP BY conv_id
)
SELECT told.conv_id, told.n_turns, told.turns_sha256, length(learnt) AS loss_chars, sha256(learnt) AS loss_sha256,
       CAST(told.chars + coalesce(repeated.chars, 0) AS BIGINT) AS formatted_chars
FROM told LEFT JOIN repeated ON repeated.conv_id = told.conv_id
"""

OP11_MERKLE_MANIFEST = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS row_id, doc_id, lang, text,
         CASE WHEN doc_id IS NULL THEN '-' ELSE strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id END
           || CASE WHEN source IS NULL THEN '-' ELSE strlen(source) || ':' || source END
           || CASE WHEN lang IS NULL THEN '-' ELSE strlen(lang) || ':' || lang END
           || CASE WHEN n_chars IS NULL THEN '-' ELSE strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars END AS head,
         list_reduce(
           list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
             lambda c: [CAST(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
           lambda crc, b: CASE WHEN b >= 0 THEN xor(crc, b) ELSE xor(crc >> 1, 3988292384 * (crc & 1)) END) AS crc
  FROM documents
),
leaves AS (
  SELECT row_id, doc_id, lang, sha256(head || CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END) AS leaf,
         CASE WHEN xor(crc, 4294967295) % 3 = 0 THEN
           sha256(head || CASE WHEN text IS NULL THEN '-'
                               ELSE strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') END) END AS tampered
  FROM d
),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n,
         dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS grp
  FROM leaves
),
nodes(grp, level, i, n, digest) AS (
  SELECT grp, 0, i, n, leaf FROM placed
  UNION ALL
  SELECT grp, any_value(level) + 1, i // 8, (any_value(n) + 7) // 8, sha256(string_agg(digest, '' ORDER BY i)) FROM nodes WHERE n > 1 GROUP BY grp, i // 8
),
upper(level, i, n, digest) AS (
  SELECT 0, grp, count(*) OVER (), digest FROM nodes WHERE n = 1
  UNION ALL
  SELECT any_value(level) + 1, i // 8, (any_value(n) + 7) // 8, sha256(string_agg(digest, '' ORDER BY i)) FROM upper WHERE n > 1 GROUP BY i // 8
),
runs AS (
  SELECT grp, level, i // 8 AS run, list(digest ORDER BY i) AS digests FROM nodes WHERE n > 1 GROUP BY grp, level, i // 8
),
upper_runs AS (SELECT level, i // 8 AS run, list(digest ORDER BY i) AS digests FROM upper WHERE n > 1 GROUP BY level, i // 8),
walk(row_id, grp, level, i, n, folded, proof) AS (
  SELECT row_id, grp, 0, i, n, coalesce(tampered, leaf), '' FROM placed
  UNION ALL
  SELECT w.row_id, w.grp, w.level + 1, w.i // 8, (w.n + 7) // 8,
         sha256(array_to_string(digests[:w.i % 8], '') || folded || array_to_string(digests[w.i % 8 + 2:], '')),
         proof || array_to_string(digests[:w.i % 8], '') || array_to_string(digests[w.i % 8 + 2:], '')
  FROM walk w JOIN runs r ON r.grp = w.grp AND r.level = w.level AND r.run = w.i // 8 WHERE w.n > 1
),
ride(row_id, level, i, n, folded, proof) AS (
  SELECT row_id, 0, grp, (SELECT max(n) FROM upper WHERE level = 0), folded, proof FROM walk WHERE n = 1
  UNION ALL
  SELECT w.row_id, w.level + 1, w.i // 8, (w.n + 7) // 8,
         sha256(array_to_string(digests[:w.i % 8], '') || folded || array_to_string(digests[w.i % 8 + 2:], '')),
         proof || array_to_string(digests[:w.i % 8], '') || array_to_string(digests[w.i % 8 + 2:], '')
  FROM ride w JOIN upper_runs r ON r.level = w.level AND r.run = w.i // 8 WHERE w.n > 1
)
SELECT p.doc_id, p.leaf, s.digest AS subroot, r.digest AS root, sha256(f.proof) AS proof_sha256, f.folded AS folded_root, f.folded = r.digest AS verified
FROM placed p JOIN nodes s ON s.grp = p.grp AND s.n = 1 JOIN upper r ON r.n = 1 JOIN ride f ON f.row_id = p.row_id AND f.n = 1
"""

_CODE_ROUND = """
near{r} AS (
  SELECT p.vec_id, p.part, min(CAST(p.pp - 2 * list_dot_product(p.p, b.e) + list_dot_product(b.e, b.e) AS BIGINT) * 256 + b.entry) AS best
  FROM parts p JOIN book{r} b ON b.part = p.part GROUP BY p.vec_id, p.part
)"""
_CODE_MEANS = """,
means{r} AS (
  SELECT part, entry, list(m ORDER BY pos) AS e
  FROM (SELECT part, entry, pos, floor(CAST(sum(x) AS DOUBLE) / count(*)) AS m
        FROM (SELECT n.part, n.best % 256 AS entry, unnest(p.p) AS x, generate_subscripts(p.p, 1) AS pos FROM near{r} n JOIN parts p USING (vec_id, part))
        GROUP BY part, entry, pos) GROUP BY part, entry
),
book{next} AS (
  SELECT b.part, b.entry, coalesce(m.e, b.e) AS e FROM book{r} b LEFT JOIN means{r} m USING (part, entry)
),"""

OP12_VECTOR_CODES = (
    r"""
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * 1024)) AS w, len(embedding) // 4 AS width
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
),
parts AS (
  SELECT vec_id, part, p, list_dot_product(p, p) AS pp
  FROM (SELECT vec_id, part, w[part * width + 1 : (part + 1) * width] AS p FROM kept, range(4) t(part))
),
first AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept QUALIFY entry < 256),
book0 AS (SELECT p.part, f.entry, p.p AS e FROM first f JOIN parts p USING (vec_id)),"""
    + "".join(_CODE_ROUND.format(r=r) + _CODE_MEANS.format(r=r, next=r + 1) for r in range(4))
    + _CODE_ROUND.format(r=4)
    + r""",
coded AS (
  SELECT vec_id, string_agg(lower(lpad(to_hex(best % 256), 2, '0')), '' ORDER BY part) AS code, CAST(sum(best // 256) AS BIGINT) AS error FROM near4 GROUP BY vec_id
),
said AS (
  SELECT sha256(string_agg(array_to_string(list_transform(e, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM book4
)
SELECT c.vec_id, c.code, c.error, CAST(sum(c.error) OVER (PARTITION BY k.label) AS BIGINT) AS label_error, said.codebooks_sha256
FROM coded c JOIN kept k USING (vec_id), said
"""
)

ORACLES: dict[str, str] = {
    "op1_embedding_near_dedup": OP1_EMBEDDING_NEAR_DEDUP,
    "op2_line_dedup": OP2_LINE_DEDUP,
    "op3_mixing": OP3_MIXING,
    "op7_warc": OP7_WARC,
    "op10_chat": OP10_CHAT,
    "op11_merkle_manifest": OP11_MERKLE_MANIFEST,
    "op12_vector_codes": OP12_VECTOR_CODES,
}
