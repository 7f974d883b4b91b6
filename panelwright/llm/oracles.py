"""DuckDB SQL for the operators that SQL can express."""

_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

DECONTAMINATION = f"""
WITH items AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[s:s + least(10, len(w)) - 1], ' ') AS t
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS s FROM items WHERE len(w) > 0)
),
docs AS (SELECT doc_id, {_WORDS} AS w FROM documents),
places AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM docs, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n),
hits AS (SELECT p.doc_id, p.s, p.n, v.item_id FROM (SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS t FROM places) p JOIN windows v USING (n, t)),
words AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS k FROM hits) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs d LEFT JOIN words USING (doc_id) LEFT JOIN named USING (doc_id)
"""

LINE_DEDUP = """
WITH parts AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS raw, unnest(range(len(string_split(text, chr(10))))) AS no FROM documents),
lines AS (SELECT doc_id, no, raw, trim(raw, ' ') AS line FROM parts),
firsts AS (SELECT line, min({'doc_id': doc_id, 'no': no}) AS pos, length(line) AS n FROM lines WHERE line <> '' GROUP BY line),
fit AS (SELECT *, unnest([n, n + 1]) AS t FROM firsts),
keys AS (
  SELECT line, pos, t, 'l' AS side, substr(line, 1, t // 2) AS k FROM fit
  UNION ALL SELECT line, pos, t, 'r', right(line, t - t // 2) FROM fit
),
near AS (
  SELECT DISTINCT y.line FROM keys x JOIN keys y ON x.t = y.t AND x.side = y.side AND x.k = y.k AND x.pos < y.pos
  -- levenshtein counts bytes here, up to four of a character; so the two lines are compared around each character
  WHERE abs(length(x.line) - length(y.line)) <= 1 AND levenshtein(x.line, y.line) <= 4 AND len(list_filter(range(greatest(length(x.line), length(y.line))), lambda i:
    left(x.line, i) = left(y.line, i) AND right(x.line, length(x.line) - i - CAST(length(x.line) >= length(y.line) AS INT)) = right(y.line, length(y.line) - i - CAST(length(y.line) >= length(x.line) AS INT)))) > 0
),
judged AS (
  SELECT l.doc_id, l.no, l.raw, l.line <> '' AS solid, l.line = '' OR (f.pos = {'doc_id': l.doc_id, 'no': l.no} AND n.line IS NULL) AS stays
  FROM lines l LEFT JOIN firsts f ON l.line = f.line LEFT JOIN near n ON l.line = n.line
)
SELECT d.doc_id, any_value(CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(j.kept, '') END) AS text, any_value(j.n_lines) AS n_lines, any_value(j.n_removed) AS n_removed
FROM documents d LEFT JOIN (
  SELECT doc_id, string_agg(raw, chr(10) ORDER BY no) FILTER (WHERE stays) AS kept, count(*) FILTER (WHERE solid) AS n_lines, count(*) FILTER (WHERE NOT stays) AS n_removed
  FROM judged GROUP BY doc_id
) j USING (doc_id) GROUP BY d.doc_id
"""

PREFIX_TRIE = """
WITH RECURSIVE crc AS (
  SELECT b, b AS c, 0 AS k FROM range(256) t(b)
  UNION ALL SELECT b, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM crc WHERE k < 8
),
bytes AS (SELECT list(c ORDER BY b) AS t FROM crc WHERE k = 8),
turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS k
  FROM conversations WHERE conv_id IS NOT NULL
),
heads AS (
  SELECT conv_id, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT))),
    lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1])), 4294967295) % 6 AS h
  FROM (SELECT DISTINCT conv_id FROM turns), bytes
),
parts AS (
  SELECT c.conv_id, 0 AS part, k, role, text FROM heads c JOIN turns b ON b.conv_id = c.conv_id - c.conv_id % 100 AND k <= h
  UNION ALL SELECT conv_id, 1, k, role, text FROM heads JOIN turns USING (conv_id) WHERE k > h
),
rebuilt AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY part, k) AS d, md5(length(role) || ':' || role || text) AS id, length(text) AS size FROM parts),
members AS (
  SELECT conv_id, d, string_agg(id, '') OVER (PARTITION BY conv_id ORDER BY d) AS path, size FROM rebuilt
  UNION ALL SELECT conv_id, 0, '', 0 FROM heads
),
lengths AS (SELECT conv_id, max(d) AS l FROM members GROUP BY conv_id),
nodes AS (
  SELECT d, path, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(size) AS own,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE d = l), '')) AS ends_sha256
  FROM members JOIN lengths USING (conv_id) GROUP BY d, path
),
children AS (SELECT left(path, 32 * (d - 1)) AS path, d - 1 AS d, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY 1, 2),
subtrees AS (
  SELECT left(b.path, 32 * a) AS path, a AS d, count(*) FILTER (WHERE n_children IS NULL) AS n_leaves, sum(own) AS saved_tokens
  FROM (SELECT nodes.*, n_children, unnest(range(nodes.d + 1)) AS a FROM nodes LEFT JOIN children USING (d, path)) b GROUP BY 1, 2
)
SELECT n.conv_id, n.d AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM nodes n JOIN subtrees USING (d, path) LEFT JOIN children USING (d, path) LEFT JOIN nodes p ON p.d = n.d - 1 AND p.path = left(n.path, 32 * (n.d - 1))
"""
