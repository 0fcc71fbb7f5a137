"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

_BLANKS = r"[\x20\x09-\x0D]"

EXACT_DEDUP = rf"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, ''))::BIGINT AS chars,
         regexp_replace(coalesce(text, ''), '{_BLANKS}+', '', 'g') AS norm
  FROM documents),
k AS (
  SELECT doc_id, norm, count(*) OVER (PARTITION BY norm) AS group_size,
         first_value(doc_id) OVER (PARTITION BY norm ORDER BY chars DESC, doc_id ASC NULLS LAST) AS keep_id
  FROM t)
SELECT doc_id, keep_id, group_size::BIGINT AS group_size,
       doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(norm) AS text_sha256
FROM k
"""

NEAR_DEDUP = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS g
  FROM w),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS MATERIALIZED (
  SELECT a.doc_id AS a, b.doc_id AS b
  FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id
  JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, x.n, y.n
  HAVING 100 * count(*) >= 75 * (x.n + y.n - count(*))),
e AS MATERIALIZED (SELECT a, b FROM p UNION SELECT b, a FROM p),
r(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT r.doc_id, e.b FROM r JOIN e ON r.other = e.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, min(r.other) AS component_id, d.doc_id = min(r.other) AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN r USING (doc_id)
GROUP BY d.doc_id, n.n
"""

WARC = r"""
WITH t AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
k AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS best FROM t)
SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(0, 8), lambda i:
    array_to_string(list_transform(range(0, 4), lambda j:
      substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(hex, 1 + 5 * i, 5))::BIGINT >> (15 - 5 * j)) & 31)::INT, 1)), '')), '') AS payload_digest,
  CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = best THEN NULL ELSE best END AS refers_to
FROM k
"""

LINE_DEDUP = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS line_no
  FROM documents),
o AS MATERIALIZED (
  SELECT doc_id, line_no, doc_id::HUGEINT * 2147483648 + line_no AS ord,
    array_to_string(regexp_extract_all(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), ' ') AS norm
  FROM l),
f AS MATERIALIZED (SELECT norm, min(ord) AS first FROM o WHERE norm <> '' GROUP BY norm),
w AS (SELECT norm, first, string_split(norm, ' ') AS ws FROM f),
v AS MATERIALIZED (
  SELECT norm, first, i, array_to_string(list_concat(ws[1:i - 1], ws[i + 1:]), ' ') AS v
  FROM (SELECT norm, first, ws, unnest(range(1, len(ws) + 1)) AS i FROM w WHERE len(ws) >= 5)),
near AS (
  SELECT norm FROM (SELECT norm, first, min(first) OVER (PARTITION BY v, i) AS low FROM v) WHERE low < first
  UNION
  SELECT v.norm FROM v JOIN w ON w.norm = v.v AND len(w.ws) >= 5 WHERE w.first < v.first
  UNION
  SELECT w.norm FROM v JOIN w ON w.norm = v.v AND len(w.ws) >= 5 WHERE v.first < w.first),
gone AS (
  SELECT o.doc_id, o.line_no FROM o JOIN f USING (norm)
  WHERE o.ord > f.first OR o.norm IN (SELECT norm FROM near))
SELECT d.doc_id, len(string_split(coalesce(d.text, ''), chr(10)))::BIGINT AS n_lines, count(g.line_no)::BIGINT AS n_removed,
       coalesce(string_agg(g.line_no::VARCHAR, ',' ORDER BY g.line_no), '') AS removed
FROM documents d LEFT JOIN gone g USING (doc_id)
GROUP BY d.doc_id, d.text
"""

MIX = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS text,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size
  FROM documents),
k AS (
  SELECT doc_id, source, size,
         -ln((('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0)
         / greatest(0.05::DOUBLE, coalesce(clean * clean * clean * clean, 0.0::DOUBLE)) AS key
  FROM (SELECT *, 1.0::DOUBLE - (length(text) - length(regexp_replace(text, '[!-@\[-`{-~]', '', 'g')))::DOUBLE / nullif(length(text), 0)::DOUBLE AS clean FROM d)),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
b AS (
  SELECT source, source_size, source_size::DOUBLE * 2.0 AS cap,
         [5.0::DOUBLE, 2.0, 1.0][(row_number() OVER (ORDER BY source COLLATE "C" ASC NULLS LAST) - 1) % 3 + 1] AS weight
  FROM s),
c AS (
  SELECT *, (sum(source_size) OVER ())::DOUBLE * 1.5 - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS left_,
         sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS wleft
  FROM b),
t AS (
  SELECT source, source_size,
         least(cap, coalesce(max(CASE WHEN cap * wleft > left_ * weight THEN left_ / wleft END) OVER () * weight, cap)) AS target
  FROM c),
p AS (
  SELECT k.doc_id, k.size, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size)::BIGINT ELSE 0 END AS epochs,
         coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE + k.size::DOUBLE / 2 AS middle
  FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       ((epochs + CASE WHEN target - epochs * source_size > 0 AND middle <= target - epochs * source_size THEN 1 ELSE 0 END) * size)::BIGINT AS taken
FROM p
"""

HARD_NEGATIVES = r"""
WITH v AS MATERIALIZED (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, list_dot_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q) WHERE a.vec_id % 100 = 0),
p AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score
  FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM (
  SELECT p.anchor_id, positive_id, positive_score, other AS negative_id, score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
WHERE rank <= 10
"""

MERKLE = r"""
WITH RECURSIVE f AS (
  SELECT doc_id, source,
    concat(
      coalesce(octet_length(encode(doc_id::VARCHAR)) || ':' || doc_id::VARCHAR, '-'),
      coalesce(octet_length(encode(source)) || ':' || source, '-'),
      coalesce(octet_length(encode(lang)) || ':' || lang, '-'),
      coalesce(octet_length(encode(n_chars::VARCHAR)) || ':' || n_chars::VARCHAR, '-')) AS head,
    text, replace(text, chr(10), '') AS cut
  FROM documents),
c AS (
  SELECT doc_id, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: ord(substr(doc_id::VARCHAR, i::INT, 1))::BIGINT)),
    lambda x, b: list_reduce(list_prepend(xor(x, b), range(8)), lambda y, i: xor(y >> 1, CASE WHEN y & 1 = 1 THEN 3988292384 ELSE 0 END))), 4294967295::BIGINT) AS crc
  FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL)),
l AS MATERIALIZED (
  SELECT doc_id, crc, source, sha256(head || coalesce(octet_length(encode(text)) || ':' || text, '-')) AS leaf,
    sha256(head || coalesce(octet_length(encode(cut)) || ':' || cut, '-')) AS cut_leaf
  FROM f LEFT JOIN c USING (doc_id)),
p AS MATERIALIZED (
  SELECT *, dense_rank() OVER (ORDER BY source COLLATE "C" NULLS FIRST) - 1 AS g,
    row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS LAST, leaf) - 1 AS pos,
    count(*) OVER (PARTITION BY source) AS n
  FROM l),
low(g, t, pos, n, h) AS (
  SELECT g, 0, pos, n, leaf FROM p
  UNION ALL
  SELECT g, t + 1, pos // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM low WHERE n > 1 GROUP BY g, t, pos // 3, n),
sub AS MATERIALIZED (SELECT g, max(t) AS levels, arg_max(h, t) AS subroot FROM low GROUP BY g),
high(t, pos, n, h) AS (
  SELECT 0, g, (SELECT count(*) FROM sub), subroot FROM sub
  UNION ALL
  SELECT t + 1, pos // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM high WHERE n > 1 GROUP BY t, pos // 3, n),
nodes AS MATERIALIZED (
  SELECT g, t, pos, h FROM low WHERE n > 1
  UNION ALL
  SELECT -1, t, pos, h FROM high WHERE n > 1),
steps AS MATERIALIZED (
  SELECT a.g, a.t, a.pos, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS l, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS r
  FROM nodes a JOIN nodes b ON a.g = b.g AND a.t = b.t AND a.pos // 3 = b.pos // 3
  GROUP BY a.g, a.t, a.pos),
way AS MATERIALIZED (
  SELECT p.g, p.pos AS leaf_pos, s.t AS k, s.l, s.r FROM p JOIN steps s ON s.g = p.g AND s.pos = p.pos // pow(3, s.t)::BIGINT
  UNION ALL
  SELECT p.g, p.pos, u.levels + s.t, s.l, s.r FROM p JOIN sub u ON u.g = p.g JOIN steps s ON s.g = -1 AND s.pos = p.g // pow(3, s.t)::BIGINT),
proof AS (SELECT g, leaf_pos, string_agg(l || r, '' ORDER BY k) AS proof FROM way GROUP BY g, leaf_pos),
fold(g, pos, k, h) AS (
  SELECT g, pos, 0, CASE WHEN crc % 2 = 0 THEN cut_leaf ELSE leaf END FROM p
  UNION ALL
  SELECT fold.g, fold.pos, fold.k + 1, sha256(w.l || h || w.r) FROM fold JOIN way w ON w.g = fold.g AND w.leaf_pos = fold.pos AND w.k = fold.k),
folded AS (SELECT g, pos, arg_max(h, k) AS h FROM fold GROUP BY g, pos),
root AS (SELECT arg_max(h, t) AS root FROM high)
SELECT p.doc_id, p.leaf, u.subroot, root.root, sha256(coalesce(q.proof, '')) AS proof_sha256, o.h AS folded_root, o.h = root.root AS verified
FROM p JOIN sub u ON u.g = p.g JOIN folded o ON o.g = p.g AND o.pos = p.pos LEFT JOIN proof q ON q.g = p.g AND q.leaf_pos = p.pos, root
"""

def _line_rules() -> str:
    from veristrata.llm.linefirst import BOILERPLATE, ENDS, MARKS, NAVIGATION, SEPARATOR

    marks, ends = (c.replace("'", "''") for c in (MARKS, ENDS))
    return rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS MATERIALIZED (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws, string_split(text, chr(10)) AS ls FROM t),
v AS (SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)),
r AS (SELECT doc_id, i FROM v QUALIFY count(*) OVER (PARTITION BY doc_id, k) > 1),
n AS MATERIALIZED (SELECT doc_id, sum(step) AS n FROM (SELECT doc_id, least(8, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 8)) AS step FROM r) GROUP BY doc_id),
l AS (SELECT doc_id, raw, regexp_replace(raw, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS l FROM (SELECT doc_id, unnest(ls) AS raw FROM w)),
m AS (
  SELECT doc_id, raw, l, length(regexp_replace(l, '{_BLANKS}', '', 'g')) AS chars, len(regexp_extract_all(l, '[^\x20\x09-\x0D]+')) AS n,
    length(l) - length(translate(l, '{marks}', '')) AS marks, len(string_split_regex(l, '{SEPARATOR}')) - 1 AS bars, lower(l) AS low
  FROM l WHERE l <> ''),
s AS MATERIALIZED (
  SELECT doc_id, count(*) - count(DISTINCT raw) AS dup, sum(chars) FILTER (
    (n < 6 AND NOT regexp_matches(l, '{ends}')) OR (marks > 3 AND 100 * marks > 15 * chars)
    OR (bars >= 2 AND n <= 4 * bars) OR (n <= 8 AND regexp_matches(low, '^({"|".join(NAVIGATION)})([^a-z]|$)'))
    OR regexp_matches(low, '{"|".join(BOILERPLATE)}')) AS lost
  FROM m GROUP BY doc_id),
b AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(text, '{_BLANKS}', '', 'g'))::BIGINT AS word_chars,
    (length(text) - length(translate(text, '#*$%&|<>', '')))::BIGINT AS n_symbols, coalesce(dup, 0)::BIGINT AS n_dup_lines,
    coalesce(n, 0)::BIGINT AS n_repeat_words, coalesce(lost, 0) AS lost
  FROM w LEFT JOIN s USING (doc_id) LEFT JOIN n USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND 100 * lost <= 40 * word_chars AS kept
FROM b
"""


LINE_RULES = _line_rules()

ORACLES = {
    "op2_bbit_minhash": NEAR_DEDUP,
    "op5_warc_segments": WARC,
    "op7_extendible_hash": EXACT_DEDUP,
    "op8_deletion_neighbourhood": LINE_DEDUP,
    "op9_weighted_mix": MIX,
    "op11_ball_tree_negatives": HARD_NEGATIVES,
    "op12_fractal_manifest": MERKLE,
    "op13_line_first": LINE_RULES,
}
