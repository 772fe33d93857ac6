"""DuckDB SQL for those queries of this folder that SQL can state, written from their contracts."""

from __future__ import annotations

_LOWER = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PLAIN = r"'[^\x20\x09-\x0D]+'"

JACCARD = rf"""WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all({_LOWER.format('text')}, {_PLAIN}) AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(
    list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w
), items AS (SELECT doc_id, unnest(s) AS x FROM sets), sizes AS (SELECT doc_id, len(s) AS n FROM sets),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM items a JOIN items b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b, common, n.n AS na, m.n AS nb FROM shared JOIN sizes n ON n.doc_id = a JOIN sizes m ON m.doc_id = b
  WHERE 100 * common >= 80 * (n.n + m.n - common)
), classes AS (
  SELECT doc_id, least(doc_id, coalesce((SELECT min(b) FROM links l WHERE l.a = s.doc_id AND common = na AND common = nb), doc_id)) AS class FROM sizes s
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM sizes UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b
)
SELECT s.doc_id, s.n AS n_shingles, (SELECT min(b) FROM reach r WHERE r.a = s.doc_id) AS component_id,
  (SELECT count(DISTINCT d.class) FROM links l JOIN classes d ON d.doc_id = l.b WHERE l.a = s.doc_id AND d.class <> c.class) AS n_links
FROM sizes s JOIN classes c USING (doc_id)"""

EXACT_TOPK = """WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s QUALIFY rank <= 5"""

SUBSTRINGS = rf"""WITH w AS (
  SELECT doc_id, row_number() OVER () AS doc, regexp_extract_all(coalesce(text, ''), {_PLAIN}) AS w FROM documents
), windows AS (
  SELECT doc, i, md5(array_to_string(w[i:i + 34], ' ')) AS h FROM (SELECT doc, w, unnest(range(1, len(w) - 33)) AS i FROM w WHERE len(w) >= 35)
), again AS (SELECT h FROM windows GROUP BY h HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc, unnest(range(i, i + 35)) AS i FROM windows WHERE h IN (SELECT h FROM again)),
kept AS (
  SELECT doc, string_agg(word, ' ' ORDER BY i) AS kept FROM (SELECT doc, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM w) x
  WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.doc = x.doc AND g.i = x.i) GROUP BY doc
)
SELECT w.doc_id, len(w.w) AS n_words, (SELECT count(*) FROM gone g WHERE g.doc = w.doc) AS n_removed,
  sha256(coalesce(kept.kept, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc)"""

COLLOCATIONS = rf"""WITH pieces AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({_LOWER.format('text')}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)
), totals AS (SELECT lang, sum(len(w)) AS n FROM pieces GROUP BY lang),
runs AS (
  SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase FROM (
    SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM pieces, (VALUES (1), (2), (3), (4)) sizes(m) WHERE len(w) >= m)
), f AS (SELECT lang, m, phrase, count(*) AS a FROM runs GROUP BY ALL HAVING count(*) >= 30),
cuts AS (
  SELECT c.lang, c.phrase, c.m, c.a, k, l.a AS l, r.a AS r, CAST(2000000::HUGEINT * c.a // (l.a + r.a) AS BIGINT) AS score FROM (
    SELECT *, string_split(phrase, ' ') AS w, unnest(range(1, m)) AS k FROM f WHERE m > 1) c
  JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:c.k], ' ')
  JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[c.k + 1:], ' ')
), worst AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
free AS (
  SELECT * FROM worst p WHERE NOT EXISTS (SELECT 1 FROM f q WHERE q.lang = p.lang AND q.m > p.m AND 100::HUGEINT * q.a >= 80::HUGEINT * p.a
    AND contains(' ' || q.phrase || ' ', ' ' || p.phrase || ' '))
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, score
FROM free JOIN totals USING (lang) QUALIFY rank <= 2000"""

_ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
DECONTAMINATION = rf"""WITH d AS (
  SELECT doc_id, row_number() OVER () AS doc, regexp_extract_all({_LOWER.format('text')}, {_ALNUM}) AS w FROM documents
), b AS (SELECT item_id, regexp_extract_all({_LOWER.format('text')}, {_ALNUM}) AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS m, array_to_string(w[i:i + 9], ' ') AS x
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT m FROM windows),
found AS (
  SELECT p.doc, p.i, p.m, v.item_id FROM (
    SELECT doc, i, m, array_to_string(w[i:i + m - 1], ' ') AS x FROM (
      SELECT doc, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, sizes WHERE len(w) >= m)) p JOIN windows v ON v.m = p.m AND v.x = p.x
), hit AS (SELECT doc, count(DISTINCT i) AS n FROM (SELECT doc, unnest(range(i, i + m)) AS i FROM found) GROUP BY doc),
named AS (SELECT doc, count(*) AS n, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc, CAST(item_id AS VARCHAR) AS id FROM found) GROUP BY doc)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(hit.n, 0) AS n_hit, coalesce(named.n, 0) AS n_items,
  sha256(coalesce(named.ids, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc) LEFT JOIN named USING (doc)"""

# crc32 bit by bit: the polynomial 0xEDB88320 and the mask of 32 bits are fixed values
_CRC32 = """xor(list_reduce(list_transform(range(1, length({0}) + 1), lambda i: CAST(ascii({0}[i]) AS BIGINT)), lambda acc, byte:
  list_reduce(range(8)::BIGINT[], lambda c, k: xor(c >> 1, (c & 1) * 3988292384), xor(acc, byte)), 4294967295::BIGINT), 4294967295)"""
PREFIX_TRIE = f"""WITH own AS (
  SELECT conv_id, list(struct_pack(r := coalesce(role, ''), t := coalesce(text, '')) ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS s
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), hashed AS (SELECT conv_id, s, {_CRC32.format('CAST(conv_id AS VARCHAR)')} % 6 AS h FROM own),
rebuilt AS (
  SELECT c.conv_id, list_concat(CASE WHEN o.s IS NULL THEN [] ELSE o.s[1:c.h] END, c.s[c.h + 1:]) AS s
  FROM hashed c LEFT JOIN own o ON o.conv_id = c.conv_id - c.conv_id % 100
), prefixes AS (SELECT conv_id, s, d, s[1:d] AS p FROM (SELECT *, unnest(range(0, len(s) + 1)) AS d FROM rebuilt)),
nodes AS (
  SELECT p, d, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (len(s) = d), '')) AS ends_sha256
  FROM prefixes GROUP BY p, d
), family AS (
  SELECT n.*, (SELECT count(*) FROM nodes c WHERE c.d = n.d + 1 AND c.p[1:n.d] = n.p) AS n_children FROM nodes n
), below AS (
  SELECT n.p, count(*) FILTER (b.n_children = 0) AS n_leaves, sum(CASE WHEN b.d > 0 THEN (b.n_convs - 1) * length(b.p[b.d].t) ELSE 0 END) AS saved
  FROM family n JOIN family b ON b.d >= n.d AND b.p[1:n.d] = n.p GROUP BY n.p
)
SELECT n.conv_id, n.d AS depth, u.conv_id AS parent_conv_id, n.n_convs, n.n_children, b.n_leaves, CAST(b.saved AS BIGINT) AS saved_tokens, n.ends_sha256
FROM family n JOIN below b ON b.p = n.p LEFT JOIN nodes u ON u.d = n.d - 1 AND u.p = n.p[1:n.d - 1] AND n.d > 0"""

ORACLE = {
    "op3_jaccard": JACCARD,
    "op8_exact_topk": EXACT_TOPK,
    "op10_substrings": SUBSTRINGS,
    "op11_collocations": COLLOCATIONS,
    "op12_decontamination": DECONTAMINATION,
    "op13_prefix_trie": PREFIX_TRIE,
}
