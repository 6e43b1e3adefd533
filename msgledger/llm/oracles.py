"""DuckDB SQL for those queries that SQL can express."""

SQL = {
    "op4_exact_dedup": r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id) = 1 AS kept, text_sha256
FROM d
""",
    "op1_url_filters": r"""
WITH rules(host, path, action) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
a AS (SELECT page_id, row_number() OVER () AS n, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, n, split_part(split_part(rest, '?', 1), '#', 1) AS whole FROM a),
c AS (SELECT page_id, n, translate(split_part(whole, '/', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             CASE WHEN instr(whole, '/') > 0 THEN substr(whole, instr(whole, '/')) ELSE '' END AS path FROM b),
d AS (SELECT c.page_id, c.n, c.host, c.path, r.host || r.path AS rule, r.action,
             row_number() OVER (PARTITION BY c.n ORDER BY length(r.host || r.path) DESC, length(r.host) DESC, r.action DESC) AS k
      FROM c LEFT JOIN rules r ON (c.host = r.host OR ends_with(c.host, '.' || r.host)) AND starts_with(c.path, r.path))
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM d WHERE k = 1
""",
    "op6_mixing_sources": r"""
WITH s AS (SELECT source, count(*) AS n, pow(count(*)::DOUBLE, 0.5) AS w FROM documents GROUP BY source),
t AS (SELECT round(sum(w), 6) AS w_all, sum(n) AS n_all FROM s),
r AS (SELECT source, round(w / w_all * n_all * 1.0 / n, 9) AS rate FROM s, t),
q AS (SELECT source, rate, greatest(ceil(rate / 256.0), 1)::INT AS parts FROM r),
p AS (SELECT source, rate, parts, k, sum(exp(k * ln(rate / parts) - rate / parts - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS c
      FROM q, range(0, 400) x(k) WHERE k <= rate / parts + 12 * sqrt(rate / parts) + 40),
u AS (SELECT doc_id, text, documents.source, rate, i, ('0x' || sha256('17|' || i || '|' || doc_id)[1:13])::BIGINT / 4503599627370496.0 AS u
      FROM documents JOIN q ON documents.source IS NOT DISTINCT FROM q.source, range(1, 1000) y(i) WHERE i <= parts),
d AS (SELECT doc_id, u.source, text, u.rate, count(k) AS copies FROM u LEFT JOIN p ON p.source IS NOT DISTINCT FROM u.source AND p.c <= u.u GROUP BY ALL)
SELECT doc_id, source, rate AS mix_rate, copies::INT AS mix_copies, k::INT AS mix_copy, sha256('17|order|' || k || '|' || doc_id)[1:16] AS mix_order, sha256(text) AS text_sha256
FROM d, range(0, 10000) z(k) WHERE k < copies
""",
    "op9_exact_topk": r"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score FROM v q, v c WHERE q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 10
""",
}
