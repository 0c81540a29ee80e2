"""DuckDB SQL for the queries that SQL can express."""

OP3 = r"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body, sha256(coalesce(html, '')) AS digest, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS n FROM pages),
f AS (SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY digest) END AS first_id FROM p)
SELECT page_id, n AS payload_bytes, digest AS payload_digest, CASE WHEN page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id > first_id THEN first_id END AS refers_to
FROM f
"""

OP4 = r"""
WITH d AS (
  SELECT doc_id, source, lang, coalesce(length(text), 0) AS chars,
    coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS ws1,
    coalesce(len(regexp_extract_all(text, '[A-Za-z]+|[0-9]|[^A-Za-z0-9\x20\x09-\x0D]')), 0) AS alnum2,
    min(doc_id) OVER (PARTITION BY md5(coalesce(text, ''))) AS first_id
  FROM documents),
k AS (SELECT * FROM d WHERE NOT coalesce(doc_id > first_id, false))
SELECT source, lang, tokenizer, CAST(count(*) AS BIGINT) AS docs, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(chars) AS BIGINT) AS chars
FROM (SELECT source, lang, 'ws-1' AS tokenizer, ws1 AS tokens, chars FROM k
      UNION ALL SELECT source, lang, 'alnum-2', alnum2, chars FROM k)
GROUP BY source, lang, tokenizer
"""

OP10 = r"""
WITH RECURSIVE slim AS (
  SELECT source, doc_id, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS tok FROM documents),
totals AS (SELECT source, sum(tok)::BIGINT AS t FROM slim GROUP BY source HAVING sum(tok) > 0),
head AS (SELECT sum(t)::DOUBLE AS whole, count(*) AS n FROM totals),
p AS (SELECT source, t, t / whole AS p, whole, n FROM totals, head),
half(step, what, low, high) AS (
  SELECT 0, what, -1e-9::DOUBLE, 1.0::DOUBLE FROM (VALUES ('entropy'), ('repeats')) v(what)
  UNION ALL
  SELECT step + 1, what, CASE WHEN good THEN low ELSE mid END, CASE WHEN good THEN mid ELSE high END
  FROM (
    SELECT step, what, low, high, (low + high) / 2 AS mid,
      CASE what
        WHEN 'entropy' THEN (SELECT ln(sum(pow(p, (low + high) / 2))) - (low + high) / 2 * sum(pow(p, (low + high) / 2) * ln(p)) / sum(pow(p, (low + high) / 2)) <= 0.98 * ln(max(n)) + 1e-12 FROM p)
        ELSE (SELECT max(pow(p, (low + high) / 2) / p) / sum(pow(p, (low + high) / 2)) <= 4.0 * (1 + 1e-12) FROM p)
      END AS good
    FROM half WHERE step < 45)),
a AS (SELECT greatest(0.0, max(round(high, 9))) AS a FROM half WHERE step = 45),
norm AS (SELECT sum(pow(p, a)) AS s FROM p, a),
plan AS (
  SELECT source, t, round(pow(p, a) / s, 9) AS weight, CAST(floor(pow(p, a) / s * whole + 1e-6) AS BIGINT) AS pays FROM p, a, norm),
rows_ AS (
  SELECT s.source, s.doc_id, s.tok, weight, pays // t AS blocks, pays % t AS rest,
    unnest(range(0, CASE WHEN pays % t > 0 THEN pays // t + 1 ELSE pays // t END)) AS block
  FROM slim s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source),
ranked AS (
  SELECT *, row_number() OVER w AS position, sum(tok) OVER (w ROWS UNBOUNDED PRECEDING) AS cum
  FROM rows_ WINDOW w AS (PARTITION BY source, block ORDER BY md5('7:' || block || ':' || coalesce(CAST(doc_id AS VARCHAR), 'null' || tok)), doc_id, tok))
SELECT source, CAST(block AS INTEGER) AS block, CAST(position AS BIGINT) AS position, doc_id, tok AS tokens, weight
FROM ranked WHERE block < blocks OR cum <= rest
"""

ORACLES = {"op3_warc": OP3, "op4_token_rollup": OP4, "op10_temperature_mix": OP10}
