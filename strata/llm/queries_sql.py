"""DuckDB SQL of the training-data queries that SQL can express."""

from __future__ import annotations

_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

OP4 = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM benchmark),
bn AS (SELECT item_id, ws, least(10, len(ws)) AS k FROM b WHERE len(ws) > 0),
bw AS (
  SELECT DISTINCT item_id, k, array_to_string(list_slice(ws, p, p + k - 1), ' ') AS win
  FROM (SELECT item_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS p FROM bn)),
ks AS (SELECT DISTINCT k FROM bn),
dw AS (
  SELECT doc_id, k, p, array_to_string(list_slice(ws, p, p + k - 1), ' ') AS win
  FROM (SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS p FROM d, ks WHERE len(ws) >= k)),
hit AS (SELECT dw.doc_id, dw.k, dw.p, bw.item_id FROM dw JOIN bw ON dw.k = bw.k AND dw.win = bw.win),
words AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + k)) AS q FROM hit) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.ws) AS BIGINT) AS n_words, CAST(coalesce(w.n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(i.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(i.ids, '')) AS items_sha256,
  coalesce(w.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words w USING (doc_id) LEFT JOIN items i USING (doc_id)
"""

OP8 = rf"""
WITH u AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
hp AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), {_LOWER}) AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
rules(verdict, rhost, rpath) AS (
  VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
    ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
best AS (
  SELECT page_id, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(verdict, length(rhost || rpath)) AS verdict
  FROM hp JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id)
SELECT hp.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM hp LEFT JOIN best USING (page_id)
"""

OP1 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes, sha1(h) AS payload_digest FROM p),
b AS (SELECT payload_digest, max(page_id) AS best FROM d WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id <> best THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id <> best THEN best END AS refers_to
FROM d LEFT JOIN b USING (payload_digest)
"""

OP2 = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations GROUP BY ALL),
p AS (SELECT DISTINCT conv_id AS p_conv, role AS perspective FROM t WHERE role <> 'system'),
s AS (
  SELECT conv_id, perspective, turn, role, text, md5(role || chr(0) || text) AS tie,
    CASE WHEN role = perspective THEN '<|assistant|>' WHEN role = 'system' THEN '<|system|>'
      ELSE '<|user:' || role || '|>' END || chr(10) AS head
  FROM t JOIN p ON conv_id IS NOT DISTINCT FROM p_conv),
o AS (
  SELECT *, length(head) + length(text) + 1 AS size,
    sum(length(head) + length(text) + 1) OVER (
      PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, tie, role, text ROWS UNBOUNDED PRECEDING) AS upto
  FROM s),
b AS (SELECT *, upto - size AS start, CAST(floor((upto - size) / 1000000) AS BIGINT) AS block FROM o)
SELECT conv_id, perspective, block, count(*) AS n_turns, CAST(min(start) AS BIGINT) AS start,
  string_agg(head || text || chr(10), '' ORDER BY start) AS text,
  coalesce(string_agg(CAST(start + length(head) AS BIGINT) || '-' || CAST(upto AS BIGINT), ',' ORDER BY start)
    FILTER (WHERE role = perspective), '') AS mask
FROM b GROUP BY conv_id, perspective, block
"""

OP12 = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (
  SELECT rid, doc_id, p, md5(array_to_string(list_slice(ws, p, p + 49), ' ')) AS win
  FROM (SELECT rid, doc_id, ws, unnest(range(1, len(ws) - 48)) AS p FROM d WHERE len(ws) >= 50)),
m AS (SELECT win, min(doc_id) AS least FROM w GROUP BY win),
gone AS (
  SELECT DISTINCT rid, unnest(range(p, p + 50)) AS q
  FROM (SELECT rid, p FROM w JOIN m USING (win) WHERE doc_id > least)),
kept AS (
  SELECT rid, string_agg(word, ' ' ORDER BY q) AS txt, count(*) AS n
  FROM (SELECT rid, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS q FROM d) ANTI JOIN gone USING (rid, q) GROUP BY rid)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(txt, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (rid)
"""

OP13 = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
tf AS (SELECT rid, term, count(*) AS tf FROM (SELECT rid, unnest(ws) AS term FROM d) GROUP BY ALL),
s AS (SELECT count(*) FILTER (len(ws) > 0) AS n_docs, CAST(sum(len(ws)) AS BIGINT) AS n_terms FROM d),
w AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(n_docs) + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w
  FROM tf, s GROUP BY term),
b AS (
  SELECT row_number() OVER () AS bid, item_id,
    regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM benchmark),
bt AS (SELECT bid, item_id, term, count(*) AS r FROM (SELECT bid, item_id, unnest(ws) AS term FROM b) GROUP BY ALL),
m AS (SELECT rid, doc_id, 100 - 25 + ((25 * len(ws) * n_docs) // n_terms) AS m FROM d, s WHERE len(ws) > 0),
sc AS (
  SELECT bid, item_id, rid, doc_id, CAST(sum(r * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
  FROM bt JOIN w USING (term) JOIN tf USING (term) JOIN m USING (rid) GROUP BY bid, item_id, rid, doc_id),
o AS (SELECT *, row_number() OVER (PARTITION BY bid ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM sc WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM o WHERE rank <= 20
"""

OP11 = """
WITH t AS (
  SELECT conv_id, turn, length(coalesce(text, '')) AS c,
    sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS d
  FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list({'d': d, 'c': c} ORDER BY turn NULLS FIRST, d) AS seq FROM t GROUP BY conv_id),
h AS (
  SELECT conv_id, seq, xor(4294967295, list_reduce(
    list_concat([4294967295::BIGINT], list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: ascii(x)::BIGINT)),
    lambda acc, b: list_reduce(list_concat([xor(acc, b)], range(8)), lambda a, i: xor(a >> 1, 3988292384 * (a & 1))))) % 6 AS h
  FROM own),
r AS (
  SELECT h.conv_id, list_concat(list_slice(coalesce(o.seq, []), 1, h), list_slice(h.seq, h + 1, len(h.seq))) AS seq
  FROM h LEFT JOIN own o ON o.conv_id = h.conv_id - h.conv_id % 100),
pre AS (
  SELECT conv_id, d, list_slice(seq, 1, d) AS p, len(seq) = d AS ends
  FROM (SELECT conv_id, seq, unnest(range(0, len(seq) + 1)) AS d FROM r)),
n AS (
  SELECT d, p, min(conv_id) AS conv_id, count(*) AS n,
    string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends) AS ids
  FROM pre GROUP BY d, p),
k AS (SELECT d - 1 AS d, list_slice(p, 1, d - 1) AS p, count(*) AS k FROM n WHERE d > 0 GROUP BY ALL),
v AS (
  SELECT n.d, n.p, CASE WHEN k IS NULL THEN 1 ELSE 0 END AS leaf,
    CASE WHEN n.d = 0 THEN 0 ELSE (n - 1) * n.p[n.d].c END AS saved
  FROM n LEFT JOIN k ON n.d = k.d AND n.p = k.p),
s AS (
  SELECT a AS d, list_slice(p, 1, a) AS p, sum(leaf) AS leaves, sum(saved) AS saved
  FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM v) GROUP BY ALL)
SELECT n.conv_id, n.d AS depth, u.conv_id AS parent_conv_id, n.n AS n_convs, coalesce(k.k, 0) AS n_children,
  CAST(s.leaves AS BIGINT) AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, sha256(coalesce(n.ids, '')) AS ends_sha256
FROM n JOIN s ON n.d = s.d AND n.p = s.p LEFT JOIN k ON n.d = k.d AND n.p = k.p
  LEFT JOIN n u ON u.d = n.d - 1 AND u.p = list_slice(n.p, 1, n.d - 1)
"""
