"""DuckDB SQL for the operators that SQL can express, over whole tables."""

OP2 = r"""
WITH u AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
r(verdict, host, path) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'),
  ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/'))
SELECT u.page_id, u.host, u.path,
       (SELECT arg_max(r.host || r.path, length(r.host) + length(r.path)) FROM r
        WHERE (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path)) AS rule,
       coalesce((SELECT arg_max(r.verdict, length(r.host) + length(r.path)) FROM r
        WHERE (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path)), 'allow') AS verdict
FROM u
"""

OP6 = r"""
WITH l AS (
  SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents)),
k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (
  SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.*, (c.key IS NOT NULL AND k.doc_id <> c.last) AS gone FROM k LEFT JOIN c ON k.key = c.key)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""

OP11 = r"""
WITH u AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
         regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS units
  FROM documents),
c AS (
  SELECT *, len(units) AS n, CAST('0x' || substr(h, 1, 8) AS UBIGINT) % (len(units) + 1) AS c1,
         CAST('0x' || substr(h, 9, 8) AS UBIGINT) % (len(units) + 1) AS c2,
         CAST('0x' || substr(h, 17, 8) AS UBIGINT) % 100 AS c3, CAST('0x' || substr(h, 25, 8) AS UBIGINT) % 100 AS c4
  FROM u),
f AS (
  SELECT *, array_to_string(units[1:least(c1, c2)], '') AS p, array_to_string(units[least(c1, c2) + 1:greatest(c1, c2)], '') AS m,
         array_to_string(units[greatest(c1, c2) + 1:n], '') AS s,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR c3 >= 90 THEN 'plain'
              WHEN c4 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m
              ELSE '<P>' || p || '<S>' || s || '<M>' || m END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM f
"""

#: CRC-32 by its table, which follows from the polynomial, over the bytes of each distinct word.
OP12 = r"""
WITH RECURSIVE bits(i, c, k) AS (
  SELECT i, i, 0 FROM range(256) r(i)
  UNION ALL
  SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS entries FROM bits WHERE k = 8),
w AS (
  SELECT 'd' AS side, doc_id AS id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM documents
  UNION ALL
  SELECT 'b', NULL, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) FROM benchmark),
v AS (SELECT word, hex(encode(word)) AS code FROM (SELECT DISTINCT word FROM w)),
steps(word, code, place, state) AS (
  SELECT word, code, 1, CAST(4294967295 AS BIGINT) FROM v
  UNION ALL
  SELECT word, code, place + 2, xor(state >> 8, entries[xor(state & 255, CAST('0x' || substr(code, place, 2) AS BIGINT)) + 1])
  FROM steps, crc WHERE place < length(code)),
b AS (SELECT word, xor(state, 4294967295) % 10000 AS bucket FROM steps WHERE place > length(code)),
n AS (
  SELECT bucket, count(*) FILTER (side = 'd') AS s, count(*) FILTER (side = 'b') AS t FROM w JOIN b USING (word) GROUP BY bucket),
g AS (
  SELECT bucket, CAST(floor(1000 * ln((CAST(t AS DOUBLE) + 1) * ((SELECT sum(s) FROM n) + 10000.0)
         / ((CAST(s AS DOUBLE) + 1) * ((SELECT sum(t) FROM n) + 10000.0)))) AS BIGINT) AS gain FROM n),
d AS (
  SELECT id AS doc_id, count(*) AS n_features, CAST(floor(CAST(sum(gain) AS DOUBLE) / count(*)) AS BIGINT) AS weight
  FROM w JOIN b USING (word) JOIN g USING (bucket) WHERE side = 'd' GROUP BY id),
e AS (
  SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
         CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h
  FROM documents LEFT JOIN d USING (doc_id)),
x AS (SELECT doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5) / 4294967296.0))) AS BIGINT) AS score FROM e),
r AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, floor(10 * count(*) OVER () / 100) AS drawn
  FROM x WHERE n_features >= 20)
SELECT x.doc_id, x.n_features, x.weight, x.score, r.rank
FROM x LEFT JOIN r ON x.doc_id = r.doc_id AND r.rank <= r.drawn
"""
