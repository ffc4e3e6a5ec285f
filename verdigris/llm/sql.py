"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

URLS = r"""
WITH cut AS (
  SELECT page_id, url,
    coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
rules(action, h, p) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('block', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
numbered AS (SELECT row_number() OVER () AS n, * FROM cut),
fits AS (
  SELECT n, action, h || p AS rule, row_number() OVER (PARTITION BY n ORDER BY length(h) + length(p) DESC, length(h) DESC, action DESC) AS k
  FROM numbered JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict
FROM numbered LEFT JOIN (SELECT * FROM fits WHERE k = 1) USING (n)
"""

LEAKS = r"""
WITH doc_words AS (SELECT doc_id AS id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS w FROM documents),
item_words AS (SELECT item_id AS id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS w FROM benchmark),
lengths AS (SELECT id, CAST(min(least(5, len(w))) AS BIGINT) AS k FROM item_words WHERE len(w) > 0 GROUP BY id),
items AS (SELECT DISTINCT id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS s FROM item_words JOIN lengths USING (id) WHERE len(w) > 0),
docs AS (SELECT DISTINCT id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS s FROM doc_words, (SELECT DISTINCT k FROM lengths) WHERE len(w) >= k),
sizes AS (SELECT id, count(*) AS n FROM items GROUP BY id)
SELECT d.id AS doc_id, i.id AS item_id, max(n) AS n_shingles, count(*) AS n_shared, round(count(*) / max(n), 6) AS containment
FROM docs d JOIN items i ON d.s = i.s AND d.k = i.k JOIN sizes ON sizes.id = i.id
GROUP BY d.id, i.id HAVING count(*) >= ceil(0.8 * max(n) - 1e-9)
"""

TOPK = r"""
WITH vectors AS (
  SELECT vec_id, list_transform(embedding, lambda v: CAST(floor(CAST(v AS DOUBLE) * 256) AS BIGINT)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.x, c.x), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM vectors q JOIN vectors c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
ranked AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored)
SELECT * FROM ranked WHERE rank <= 5
"""

SUBSTRINGS = r"""
WITH words AS (
  SELECT row_number() OVER () AS n, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (SELECT n, unnest(range(1, len(w) - 33)) AS i FROM words WHERE len(w) >= 35),
hashed AS (SELECT n, i, md5(array_to_string(w[i:i + 34], ' ')) AS h FROM windows JOIN words USING (n)),
twice AS (SELECT n, i FROM hashed WHERE h IN (SELECT h FROM hashed GROUP BY h HAVING count(*) > 1)),
gone AS (SELECT DISTINCT n, unnest(range(i, i + 35)) AS j FROM twice),
marked AS (SELECT n, list(j) AS js FROM gone GROUP BY n),
opened AS (SELECT n, unnest(range(1, len(w) + 1)) AS j FROM words),
kept AS (SELECT o.n, string_agg(w[o.j], ' ' ORDER BY o.j) AS t, count(*) AS c FROM opened o JOIN words USING (n) LEFT JOIN gone g ON g.n = o.n AND g.j = o.j WHERE g.j IS NULL GROUP BY o.n)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(c, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM words LEFT JOIN kept USING (n)
"""

WARC = r"""
WITH sized AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
firsts AS (SELECT body, min(page_id) AS least FROM sized GROUP BY body),
bits AS (
  SELECT page_id, strlen(body) AS n, sha1(body) AS hex, least FROM sized JOIN firsts USING (body)),
coded AS (
  SELECT page_id, n, least, list_aggregate(list_transform(range(0, 32), lambda k:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((CAST('0x' || substr(hex, CAST(1 + 5 * (k // 4) AS BIGINT), 5) AS BIGINT) >> (15 - 5 * (k % 4))) & 31) + 1 AS BIGINT), 1)), 'string_agg', '') AS digest
  FROM bits)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest, CASE WHEN page_id = least THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> least THEN least END AS refers_to
FROM coded
"""

ORACLE = {"op2_topk": TOPK, "op4_warc": WARC, "op5_decontamination": LEAKS, "op6_url_filters": URLS, "op10_substrings": SUBSTRINGS}
