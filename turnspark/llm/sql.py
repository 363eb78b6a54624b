"""SQL twins of the queries that SQL can express."""

from __future__ import annotations

#: CRC-32 of the decimal conversation id: a table of 256 remainders, then one step a digit.
_CRC = """
crc_table AS (
  SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS t),
crc AS (
  SELECT c, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
    lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) AS h32
  FROM (SELECT DISTINCT conv_id AS c FROM conversations WHERE conv_id IS NOT NULL), crc_table)
"""

NGRAM_JOIN = """
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents WHERE text IS NOT NULL),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingles a JOIN shingles b USING (s) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM common c JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c.n >= 80 * (x.n + y.n - c.n)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
SELECT d.doc_id, coalesce(sizes.n, 0) AS n_shingles, m.b AS component_id
FROM documents d LEFT JOIN sizes USING (doc_id) JOIN (SELECT a, min(b) AS b FROM reach GROUP BY a) m ON m.a = d.doc_id
"""

PREFIX_TRIE = f"""
WITH {_CRC},
plain AS (
  SELECT conv_id AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
numbered AS (
  SELECT c, strlen(role) || ':' || role || text AS item,
    len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS words,
    row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, md5(strlen(role) || ':' || role || text)) AS pos FROM plain),
rebuilt AS (
  SELECT crc.c, pos, item, words FROM crc JOIN numbered n ON n.c = crc.c - crc.c % 20 WHERE pos <= h32 % 4
  UNION ALL
  SELECT crc.c, pos, item, words FROM crc JOIN numbered n ON n.c = crc.c WHERE pos > h32 % 4),
paths AS (
  SELECT crc.c, coalesce(l.items, []) AS items, coalesce(l.words, []) AS words FROM crc LEFT JOIN (
    SELECT c, list(item ORDER BY pos) AS items, list(words ORDER BY pos) AS words FROM rebuilt GROUP BY c) l USING (c)),
steps AS (
  SELECT c, d, items[1:d] AS path, len(items) AS n, CASE WHEN d = 0 THEN 0 ELSE words[d] END AS w
  FROM (SELECT *, unnest(range(len(items) + 1)) AS d FROM paths)),
nodes AS (
  SELECT path, min(c) AS conv_id, any_value(d) AS depth, count(*) AS n_convs, any_value(w) AS w,
    sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE n = d), '')) AS ends_sha256
  FROM steps GROUP BY path),
kids AS (SELECT path[1:depth - 1] AS path, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1),
full_nodes AS (SELECT nodes.*, coalesce(kids.n, 0) AS n_children FROM nodes LEFT JOIN kids USING (path)),
below AS (
  SELECT path[1:a] AS path, sum((n_convs - 1) * w) AS saved, count(*) FILTER (WHERE n_children = 0) AS leaves
  FROM (SELECT *, unnest(range(depth + 1)) AS a FROM full_nodes) GROUP BY 1)
SELECT f.conv_id, f.depth, p.conv_id AS parent_conv_id, f.n_convs, f.n_children, leaves AS n_leaves,
  saved::BIGINT AS saved_tokens, f.ends_sha256
FROM full_nodes f JOIN below USING (path)
LEFT JOIN full_nodes p ON f.depth > 0 AND p.path = f.path[1:f.depth - 1]
"""


def _round(n: int) -> str:
    """Assign all parts to book n and move its entries to the floor of their mean."""
    return f"""
a{n} AS (
  SELECT vec_id, p.part, arg_min(e, (dist, e)) AS e, min(dist) AS dist FROM (
    SELECT vec_id, x.part, b.e, list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS dist
    FROM parts x JOIN b{n} b ON b.part = x.part) p GROUP BY 1, 2),
m{n} AS (
  SELECT part, e, list((s - ((s % k) + k) % k) // k ORDER BY place) AS c FROM (
    SELECT part, e, place, sum(v[place])::BIGINT AS s, count(*) AS k
    FROM a{n} JOIN parts USING (vec_id, part), (SELECT unnest(range(1, len(v) + 1)) AS place FROM (SELECT v FROM parts LIMIT 1))
    GROUP BY 1, 2, 3) GROUP BY 1, 2),
b{n + 1} AS (SELECT part, e, coalesce(m.c, b.c) AS c FROM b{n} b LEFT JOIN m{n} m USING (part, e))"""


VECTOR_CODES = f"""
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS (
  SELECT vec_id, part, v[part * (len(v) // 16) + 1 : (part + 1) * (len(v) // 16)] AS v FROM kept, (SELECT unnest(range(16)) AS part)),
b0 AS (
  SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS e, v AS c FROM parts
  WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT 64)),
{_round(0)},
{_round(1)},
{_round(2)},
book AS (
  SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, e)) AS h FROM b2),
codes AS (
  SELECT vec_id, string_agg(lower(printf('%02x', e)), '' ORDER BY part) AS code, sum(dist)::BIGINT AS error FROM a2 GROUP BY 1)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, h AS codebooks_sha256
FROM codes JOIN kept USING (vec_id), book
"""
