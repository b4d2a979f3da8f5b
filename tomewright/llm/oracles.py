"""DuckDB SQL for the registered queries that SQL can express."""

from __future__ import annotations

#: All pairs, then the closure of the links.
_VECTORS = """
WITH RECURSIVE n AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
s AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS norm FROM n),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM s a JOIN s b ON a.vec_id <> b.vec_id AND list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.9),
r(id, c) AS (SELECT vec_id, vec_id FROM n UNION SELECT r.id, l.b FROM r JOIN l ON r.c = l.a),
k AS (SELECT id, min(c) AS component_id FROM r GROUP BY id), d AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT vec_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept
FROM n JOIN k ON id = vec_id LEFT JOIN d ON a = vec_id
"""

#: Sets of shingles as text, pairs by common shingles, then the closure.
_JACCARD = """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) >= 3 THEN list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))
 WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m, any_value(a.n) AS na, any_value(b.n) AS nb FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
h AS (SELECT a, b FROM p WHERE 100 * m >= 90 * (na + nb - m)), l AS (SELECT a, b FROM h UNION ALL SELECT b, a FROM h),
r(id, c) AS (SELECT doc_id, doc_id FROM s UNION SELECT r.id, l.b FROM r JOIN l ON r.c = l.a)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, min(c) AS component_id FROM s JOIN r ON id = doc_id GROUP BY doc_id, len(s)
"""

#: CRC-32 by its table, over the hexadecimal digits of the text.
_SHARDS = """
WITH RECURSIVE t(i, c, k) AS (SELECT i, i, 0 FROM range(256) x(i) UNION ALL SELECT i, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM t WHERE k < 8),
tab AS (SELECT list(c ORDER BY i) AS tab FROM t WHERE k = 8),
h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
d AS (SELECT doc_id, len(h) // 2 + 16 AS size, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(0, len(h) // 2), lambda i: CAST(('0x' || h[2 * i + 1:2 * i + 2]) AS BIGINT))),
 lambda c, b: xor(tab[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) AS text_crc32 FROM h, tab),
o AS (SELECT *, sum(size) OVER (ORDER BY doc_id, text_crc32, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS before, sum(size) OVER () AS total FROM d),
p AS (SELECT *, CAST(least(39, ((2 * before + size) * 40) // (2 * total)) AS INT) AS shard FROM o)
SELECT doc_id, CAST(size AS BIGINT) AS size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id, text_crc32, size) - 1 AS slot, CAST(NULL AS INT) AS grown_shard FROM p
"""


#: CRC-32 of each distinct word by its table, then counts, gains and the draw.
_IMPORTANCE = """
WITH RECURSIVE t(i, c, k) AS (SELECT i, i, 0 FROM range(256) x(i) UNION ALL SELECT i, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM t WHERE k < 8),
tab AS (SELECT list(c ORDER BY i) AS tab FROM t WHERE k = 8),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS w FROM benchmark),
dw AS (SELECT r, unnest(w) AS w FROM d),
u AS (SELECT w, hex(encode(w)) AS h FROM (SELECT w FROM dw UNION SELECT w FROM b)),
k AS (SELECT w, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(0, len(h) // 2), lambda i: CAST(('0x' || h[2 * i + 1:2 * i + 2]) AS BIGINT))),
 lambda c, x: xor(tab[(xor(c, x) & 255) + 1], c >> 8)), 4294967295) % 10000 AS b FROM u, tab),
s AS (SELECT b, count(*) AS s FROM dw JOIN k USING (w) GROUP BY b), tt AS (SELECT k.b, count(*) AS t FROM b JOIN k USING (w) GROUP BY k.b),
n AS (SELECT CAST((SELECT sum(s) FROM s) AS DOUBLE) AS s_all, CAST((SELECT sum(t) FROM tt) AS DOUBLE) AS t_all),
g AS (SELECT b, floor(1000 * ln((CAST(coalesce(t, 0) AS DOUBLE) + 1) * (s_all + 10000) / ((CAST(s AS DOUBLE) + 1) * (t_all + 10000)))) AS gain FROM s LEFT JOIN tt USING (b), n),
m AS (SELECT r, CAST(floor(sum(gain) / count(*)) AS BIGINT) AS weight FROM dw JOIN k USING (w) JOIN g USING (b) GROUP BY r),
e AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
 coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST(('0x' || sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), ''))[1:8]) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM d LEFT JOIN m USING (r)),
o AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id NULLS FIRST, n_features) AS rank, count(*) OVER () AS fit FROM e WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 10 * fit // 100 THEN rank END AS rank FROM o
UNION ALL SELECT doc_id, n_features, weight, score, NULL FROM e WHERE n_features < 20
"""

#: Every order run over every document.
_AUDIT = """
WITH RECURSIVE w AS (SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
f AS (SELECT r, part, len(w) < 50 AS a, 100 * len(list_distinct(w)) < 65 * len(w) AS b, 100 * len(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * len(text) AS c, regexp_matches(text, '[#$%&*|]') AS d,
 coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false) AS e, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic
 FROM w LEFT JOIN (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id) USING (doc_id)),
x AS (SELECT r, part, good, toxic, (CASE WHEN a THEN 'A' ELSE '' END) || (CASE WHEN b THEN 'B' ELSE '' END) || (CASE WHEN c THEN 'C' ELSE '' END) || (CASE WHEN d THEN 'D' ELSE '' END) || (CASE WHEN e THEN 'E' ELSE '' END) AS fails FROM f),
o(o) AS (SELECT '' UNION ALL SELECT o || l FROM o, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l) WHERE NOT contains(o, l)),
p AS (SELECT part, o AS filter_order, good, toxic, fails, (SELECT min(i) FROM range(1, 6) q(i) WHERE contains(fails, o[i])) AS gone, count(*) AS n FROM x, o WHERE len(o) = 5 GROUP BY ALL),
s AS (SELECT part, filter_order, step, filter_order[step] AS l, sum(CASE WHEN coalesce(gone, 6) > step THEN n ELSE 0 END) AS kept, sum(CASE WHEN gone = step THEN n ELSE 0 END) AS removed,
 sum(CASE WHEN contains(fails, filter_order[step]) AND gone < step THEN n ELSE 0 END) AS redundant, sum(CASE WHEN fails = filter_order[step] THEN n ELSE 0 END) AS unique_fails,
 sum(CASE WHEN gone = step AND good THEN n ELSE 0 END) AS good_lost, sum(CASE WHEN gone = step AND toxic THEN n ELSE 0 END) AS toxic_lost FROM p, range(1, 6) k(step) GROUP BY part, filter_order, step)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
 CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, l) AS BIGINT) AS shapley FROM s
"""


#: Each document is in one source, so the quotas are the flow; capped sources come
#: first in the order of size over weight.
_MIXING = """
WITH z AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size, sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), ''))[1:16] AS turn FROM documents),
q AS (SELECT source, sum(size)::HUGEINT AS total, [3, 1, 2][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::HUGEINT AS w FROM z GROUP BY source),
c AS (SELECT *, sum(total) OVER () AS every, sum(w) OVER () AS ws, coalesce(sum(2 * total) OVER o, 0) AS before, coalesce(sum(w) OVER o, 0) AS w_before FROM q WINDOW o AS (ORDER BY total::DOUBLE / w::DOUBLE, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
h AS (SELECT *, w * (150 * every - 100 * before) >= 2 * total * 100 * (ws - w_before) AS capped FROM c),
l AS (SELECT *, 150 * every - sum(CASE WHEN capped THEN 200 * total ELSE 0 END) OVER () AS above, 100 * sum(CASE WHEN capped THEN 0 ELSE w END) OVER () AS below FROM h),
t AS (SELECT source, total, CASE WHEN capped THEN 2 * total::DOUBLE ELSE w::DOUBLE * above::DOUBLE / below::DOUBLE END AS target FROM l),
y AS (SELECT source, total, target, CASE WHEN total > 0 THEN floor(target + 0.5)::BIGINT // total::BIGINT ELSE 0 END AS whole, CASE WHEN total > 0 THEN floor(target + 0.5)::BIGINT % total::BIGINT ELSE 0 END AS rest FROM t)
SELECT doc_id, size, CAST(total AS BIGINT) AS source_size, target,
 CAST(size * whole + greatest(least(rest - (sum(size) OVER (PARTITION BY z.source ORDER BY turn, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size), size), 0) AS BIGINT) AS taken
FROM z JOIN y ON z.source IS NOT DISTINCT FROM y.source
"""


def oracles() -> dict[str, str]:
    return {"op4_vectors": _VECTORS, "op5_jaccard": _JACCARD, "op8_sharding": _SHARDS, "op11_importance": _IMPORTANCE, "op12_filter_audit": _AUDIT, "op13_mixing": _MIXING}
