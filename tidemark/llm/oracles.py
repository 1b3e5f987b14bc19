"""DuckDB SQL for the operators that SQL can express over whole tables."""

MIXING = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         coalesce(length(text), 0) AS n, coalesce(length(translate(text, '#$%&*|<>{}[]=!0123456789', '')), 0) AS clean
  FROM documents),
k AS (
  SELECT doc_id, source, size,
         -ln((('0x' || substr(md5(concat_ws(':', doc_id::VARCHAR, size::VARCHAR)), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE)
         / CASE WHEN n > 0 THEN greatest(0.125::DOUBLE, 1.0::DOUBLE - 4.0::DOUBLE * (n - clean) / n) ELSE 0.125::DOUBLE END AS key
  FROM d),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         list_value(3, 1, 2)[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight
  FROM d GROUP BY source),
r AS (
  SELECT *, 2 * source_size AS cap, (2 * source_size)::DOUBLE / weight AS ratio, 1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE AS budget FROM s),
c AS (
  SELECT *, coalesce(sum(cap) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS cap_before,
         (sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS weight_from
  FROM r WINDOW w AS (ORDER BY ratio, source NULLS LAST)),
l AS (SELECT *, (budget - cap_before) / weight_from AS level FROM c),
m AS (SELECT *, (SELECT level FROM l WHERE level <= ratio ORDER BY ratio, source NULLS LAST LIMIT 1) AS water FROM l),
t AS (
  SELECT source, source_size, CASE WHEN water IS NULL OR water >= ratio THEN cap::DOUBLE ELSE water * weight END AS target FROM m),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS epochs FROM t),
p AS (
  SELECT k.*, source_size, target, epochs, target - epochs * source_size AS rest,
         coalesce(sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id NULLS LAST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target, (size * (epochs + (before + size / 2.0 <= rest)::INT))::BIGINT AS taken FROM p
"""

NEAREST = """
WITH e AS (SELECT DISTINCT vec_id, list_transform(range(1, 65), lambda i: coalesce(embedding[i] > 0, false)) AS code FROM embeddings WHERE embedding IS NOT NULL),
p AS (
  SELECT q.vec_id AS query_id, q.code AS query, e.vec_id AS id,
         list_sum(list_transform(range(1, 65), lambda i: (q.code[i] <> e.code[i])::INT))::INT AS distance
  FROM e q, e WHERE q.vec_id % 50 = 0 AND NOT (q.vec_id = e.vec_id AND q.code = e.code)),
r AS (SELECT query_id, id, distance, row_number() OVER (PARTITION BY query_id, query ORDER BY distance, id)::INT AS place FROM p)
SELECT * FROM r WHERE place <= 10
"""

WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, sha1(html) AS payload_digest FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS largest FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM largest THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM largest THEN largest END AS refers_to
FROM m
"""

NGRAM_JOIN = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))
                                    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
s AS (SELECT doc_id, unnest(g) AS s FROM g),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN g a ON a.doc_id = x JOIN g b ON b.doc_id = y WHERE 100 * c >= 75 * (len(a.g) + len(b.g) - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id AS x, doc_id AS y FROM g UNION SELECT r.x, e.y FROM r JOIN e ON e.x = r.y)
SELECT g.doc_id, len(g.g)::BIGINT AS n_shingles, m.component_id
FROM g JOIN (SELECT x, min(y) AS component_id FROM r GROUP BY x) m ON m.x = g.doc_id
"""

NEAR_DUPLICATES = f"SELECT *, doc_id IS NOT DISTINCT FROM component_id AS kept FROM ({NGRAM_JOIN.replace('75 * (len', '85 * (len')})"

DOMINANCE = """
WITH RECURSIVE step AS (
  SELECT 0 AS k, n::BIGINT AS v, n FROM range(256) t(n)
  UNION ALL
  SELECT k + 1, CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, n FROM step WHERE k < 8),
crc AS (SELECT list(v ORDER BY n) AS t FROM step WHERE k = 8),
s AS (
  SELECT sale_id, epoch_us(sold_at) // 3600000000 AS slot, floor(floor(100 * total + 0.5) / 100)::BIGINT AS level,
         1 + xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(coalesce(sale_id::VARCHAR, ''), ''), lambda x: ascii(x)::BIGINT)),
                                         lambda c, b: xor(c >> 8, t[xor(c % 256, b) + 1]))) % 2 AS w
  FROM sales, crc),
c AS (SELECT slot, level, count(*) AS n, sum(w)::BIGINT AS w FROM s WHERE slot IS NOT NULL AND level IS NOT NULL GROUP BY ALL),
a AS (
  SELECT b.slot, b.level, coalesce(sum(a.n), 0)::BIGINT AS n_sales, coalesce(sum(a.w), 0)::BIGINT AS n_rows
  FROM c b LEFT JOIN c a ON a.slot <= b.slot AND a.level > b.level GROUP BY ALL)
SELECT sale_id, s.slot, s.level, n_sales, n_rows FROM s LEFT JOIN a ON a.slot = s.slot AND a.level = s.level
"""
