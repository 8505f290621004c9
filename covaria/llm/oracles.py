"""DuckDB SQL for those queries of this subpackage that SQL can express."""

from __future__ import annotations

from covaria.llm import quality

MIX = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         (('0x' || substr(md5('mix-1|' || coalesce(doc_id::VARCHAR, 'null')), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0::DOUBLE AS u
  FROM documents),
k AS (SELECT *, -ln(u) / (0.5::DOUBLE + 0.5::DOUBLE * least(1.0::DOUBLE, size::DOUBLE / 200.0::DOUBLE)) AS key FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM k GROUP BY source),
w AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS weight FROM s),
r AS (SELECT *, source_size::DOUBLE / weight::DOUBLE AS ratio FROM w),
l AS (SELECT *, (sum(source_size) OVER ()::DOUBLE * 1.5::DOUBLE
        - 2 * coalesce(sum(source_size) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
        / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE AS level FROM r),
c AS (SELECT arg_min(level, ratio) AS common FROM l WHERE 2 * ratio > level),
t AS (SELECT l.source, source_size, CASE WHEN 2 * ratio > level THEN least((2 * source_size)::DOUBLE, common * weight) ELSE (2 * source_size)::DOUBLE END AS target FROM l CROSS JOIN c),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM t),
m AS (
  SELECT doc_id, size, source_size, target, epochs,
         sum(size) OVER (PARTITION BY k.source ORDER BY key, coalesce(doc_id::VARCHAR, ''), size RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
         - sum(size) OVER (PARTITION BY k.source, key, doc_id, size) / 2.0::DOUBLE AS middle
  FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target,
       (size * (epochs + CASE WHEN middle < target - epochs * source_size THEN 1 ELSE 0 END))::BIGINT AS taken
FROM m
"""

# SHA-1 in base 32: eight groups of five hexadecimal digits, each four letters of five bits.
WARC = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha1(h) AS hex FROM p),
b AS (
  SELECT *, list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      (((('0x' || substr(hex, ((i // 4) * 5 + 1)::INT, 5))::BIGINT >> (15 - 5 * (i % 4))::BIGINT) & 31) + 1)::INT, 1)), 'string_agg', '') AS payload_digest FROM d),
g AS (SELECT *, max(page_id) OVER (PARTITION BY hex) AS largest FROM b)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN largest IS NULL OR page_id IS NOT DISTINCT FROM largest THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN largest IS NULL OR page_id IS NOT DISTINCT FROM largest THEN NULL ELSE largest END AS refers_to
FROM g
"""

CHAT = r"""
WITH p AS (
  SELECT conv_id, turn::BIGINT AS turn, coalesce(replace(regexp_replace(role, '\r\n|[\n\x0B\x0C\r\x{85}\x{2028}\x{2029}]', ' ', 'g'), '<|', '< |'), 'unknown') AS role,
         replace(coalesce(text, ''), '<|', '< |') AS text FROM conversations),
s AS (SELECT DISTINCT conv_id, role AS perspective FROM p WHERE role <> 'system'),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k,
         CASE WHEN role = 'system' THEN '<|im_start|>system' || chr(10) ELSE '<|im_start|>user name=' || role || chr(10) END AS other FROM p),
w AS (SELECT *, (sum(length(other) + length(text) + 11) OVER (PARTITION BY conv_id ORDER BY k) - length(other) - length(text) - 11) // 1048576 AS part FROM n),
h AS (SELECT w.*, perspective, CASE WHEN role = perspective THEN '<|im_start|>assistant' || chr(10) ELSE other END AS head FROM w JOIN s ON w.conv_id IS NOT DISTINCT FROM s.conv_id),
o AS (SELECT *, sum(length(head) + length(text) + 11) OVER (PARTITION BY conv_id, perspective ORDER BY k)::BIGINT - 11 AS stop FROM h)
SELECT conv_id, perspective, part::BIGINT AS part, min(stop - length(text) - length(head))::BIGINT AS start, count(*)::BIGINT AS n_turns,
       string_agg(head || text || '<|im_end|>' || chr(10), '' ORDER BY k) AS rendered,
       coalesce(string_agg((stop - length(text))::VARCHAR || ':' || stop::VARCHAR, ',' ORDER BY k) FILTER (WHERE role = perspective), '') AS mask
FROM o GROUP BY conv_id, perspective, part
"""

#: What Python's \s matches, as a class of DuckDB's patterns.
_SPACE = r"\t-\r\x1C-\x20\x{85}\p{Z}"
_WORD = r"[^\x20\x09-\x0D]+"
_FURNITURE = "|".join(quality.BOILERPLATE) + r"|(©|\(c\)|copyright) *[12][0-9]{3}"
QUALITY = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
whole AS (
  SELECT r, doc_id, len(regexp_extract_all(t, '{_WORD}'))::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^{quality.SYMBOLS}]', '', 'g'))::BIGINT AS n_symbols FROM d),
split AS (SELECT r, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS k FROM d),
lines AS (
  SELECT r, line, len(regexp_extract_all(line, '{_WORD}')) AS words, row_number() OVER (PARTITION BY r, line ORDER BY k) > 1 AS again,
    regexp_replace(line, '[{_SPACE}]+$', '') AS stripped FROM split),
judged AS (
  SELECT r, words, again,
    again OR (words <= {quality.BOILERPLATE_WORDS} AND regexp_matches(lower(line), '{_FURNITURE}'))
    OR len(regexp_extract_all(line, '[{_SPACE}]([|»›>•·]|::|->)[{_SPACE}]')) >= 2 OR ends_with(stripped, '|') OR ends_with(stripped, '»')
    OR (words < {quality.FRAGMENT_WORDS} AND NOT regexp_matches(stripped, '[.!?…:;。．！？｡؟۔।॥։።፧፨។៕။།༎]["''”’»)\]」』]*$'))
    OR length(regexp_replace(line, '[\p{{L}}\p{{N}}\p{{M}}\x{{200C}}\x{{200D}}{_SPACE}]', '', 'g')) > {quality.MAX_MARKS}::DOUBLE * length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g')) AS failed
  FROM lines WHERE words > 0),
by_line AS (SELECT r, count(*) FILTER (again) AS n_dup_lines, sum(words) FILTER (NOT failed) AS kept_words FROM judged GROUP BY r),
words AS (SELECT r, unnest(regexp_extract_all(t, '{_WORD}')) AS a, generate_subscripts(regexp_extract_all(t, '{_WORD}'), 1) AS k FROM d),
windows AS (SELECT r, k, a, lead(a) OVER o AS b, lead(a, 2) OVER o AS c FROM words WINDOW o AS (PARTITION BY r ORDER BY k)),
found AS (SELECT r, k, c IS NOT NULL AND count(*) OVER (PARTITION BY r, a, b, c) > 1 AS twice FROM windows),
covered AS (SELECT r, twice OR coalesce(lag(twice) OVER o, false) OR coalesce(lag(twice, 2) OVER o, false) AS inside FROM found WINDOW o AS (PARTITION BY r ORDER BY k)),
by_word AS (SELECT r, count(*) FILTER (inside) AS n_repeat_words FROM covered GROUP BY r),
measured AS (
  SELECT whole.*, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(kept_words, 0) AS kept_words
  FROM whole LEFT JOIN by_line USING (r) LEFT JOIN by_word USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND kept_words >= (1 - {quality.MAX_LOST}::DOUBLE) * n_words AS kept
FROM (SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEATED_PERCENT} * n_words AS base_failed FROM measured)
"""

AUDIT = rf"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
l AS (SELECT doc_id, coalesce(max((quality = 1)::INT), 0) AS good, coalesce(max((toxic = 1)::INT), 0) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
f AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    CASE WHEN len(w) < 100 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 'B' ELSE '' END
    || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) THEN 'C' ELSE '' END || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
    || CASE WHEN min(d.doc_id) OVER (PARTITION BY t) < d.doc_id THEN 'E' ELSE '' END AS failed
  FROM d LEFT JOIN l ON d.doc_id = l.doc_id),
m AS (SELECT part, failed, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, failed),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT filter_order, step, substr(filter_order, step, 1) AS own, substr(filter_order, 1, step - 1) AS earlier FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
r AS (SELECT m.*, s.*, contains(failed, own) AS fails, length(translate(failed, earlier, '')) < length(failed) AS gone FROM m, s),
c AS (
  SELECT part, filter_order, step, own, coalesce(sum(n) FILTER (NOT gone AND NOT fails), 0) AS kept, coalesce(sum(n) FILTER (fails AND NOT gone), 0) AS removed, coalesce(sum(n) FILTER (fails AND gone), 0) AS redundant,
    coalesce(sum(n) FILTER (failed = own), 0) AS unique_fails, coalesce(sum(good) FILTER (fails AND NOT gone), 0) AS good_lost, coalesce(sum(toxic) FILTER (fails AND NOT gone), 0) AS toxic_lost
  FROM r GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
  good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley
FROM c
"""

_FIELD = "coalesce(strlen({0}::VARCHAR)::VARCHAR || ':' || {0}::VARCHAR, '-')"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars")) + " || " + _FIELD + ")"
# crc32 of the digits of doc_id, bit by bit: each byte is folded in, and -1 shifts once
MERKLE = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, lang, row_number() OVER () AS r, {_LEAF.format("text")} AS leaf, {_LEAF.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS lowered,
    xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ord(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
      lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, CASE WHEN a & 1 = 1 THEN 3988292384 ELSE 0 END) END)) AS crc
  FROM documents),
leaves AS (SELECT *, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS g, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM d),
nodes AS (
  SELECT g, 0 AS level, i, n, leaf AS h FROM leaves
  UNION ALL SELECT g, level + 1, i // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY i)) FROM nodes WHERE n > 1 GROUP BY g, level, i // 8, n),
subroots AS (SELECT g, h AS subroot FROM nodes WHERE n = 1),
upper AS (
  SELECT 0 AS level, g AS i, (SELECT count(*) FROM subroots) AS n, subroot AS h FROM subroots
  UNION ALL SELECT level + 1, i // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY i)) FROM upper WHERE n > 1 GROUP BY level, i // 8, n),
sides AS (
  SELECT g, level, i, n, coalesce(string_agg(h, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l, coalesce(string_agg(h, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
  FROM (SELECT * FROM nodes UNION ALL SELECT -1, level, i, n, h FROM upper) WINDOW w AS (PARTITION BY g, level, i // 8 ORDER BY i)),
walk AS (
  SELECT r AS doc, g, g AS up, 0 AS level, i, '' AS proof, CASE WHEN crc % 3 = 0 THEN lowered ELSE leaf END AS h, n = 1 AND (SELECT count(*) FROM subroots) = 1 AS done,
    CASE WHEN n = 1 THEN -1 ELSE g END AS tree FROM leaves
  UNION ALL
  SELECT doc, walk.g, up, CASE WHEN step.n > 8 OR tree = -1 THEN walk.level + 1 ELSE 0 END, CASE WHEN step.n > 8 OR tree = -1 THEN place // 8 ELSE up END, proof || step.l || step.r, sha256(step.l || walk.h || step.r),
    step.n <= 8 AND (tree = -1 OR (SELECT count(*) FROM subroots) = 1), CASE WHEN step.n > 8 THEN tree ELSE -1 END
  FROM (SELECT *, CASE WHEN tree = -1 AND level = 0 THEN up ELSE i END AS place FROM walk WHERE NOT done) walk JOIN sides step ON step.g = tree AND step.level = walk.level AND step.i = place)
SELECT doc_id, leaf, subroot, (SELECT h FROM upper WHERE n = 1) AS root, sha256(proof) AS proof_sha256, h AS folded_root, h = (SELECT h FROM upper WHERE n = 1) AS verified
FROM leaves JOIN subroots USING (g) JOIN (SELECT doc, proof, h FROM walk WHERE done) ON doc = r
"""

TOPK = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, max(list_inner_product(q.v, c.v))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0 GROUP BY q.vec_id, c.vec_id),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 5
"""

ORACLES = {"op3_perspective_rotation": CHAT, "op5_warc_bundles": WARC, "op2_source_mixing": MIX, "op9_quality_rules": QUALITY, "op11_filter_audit": AUDIT, "op12_merkle_manifest": MERKLE, "op13_exact_top_k": TOPK}
