"""DuckDB SQL of the training-data queries that SQL can express."""

from __future__ import annotations

SQL: dict[str, str] = {}

SQL["op1_substring_dedup"] = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 49), ' ') AS k
  FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 49)) AS i FROM d WHERE len(w) >= 50)),
gone AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 49)) AS p
  FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY k) AS least FROM win) WHERE least < doc_id),
word AS (SELECT doc_id, unnest(w) AS x, unnest(generate_series(1, len(w))) AS p FROM d WHERE len(w) > 0),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n.n, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(kept.t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN n USING (doc_id)"""

SQL["op2_exact_dedup"] = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS points,
  regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t FROM documents),
g AS (SELECT doc_id, t, first_value(doc_id) OVER (PARTITION BY t ORDER BY points DESC, doc_id) AS keep_id,
  count(*) OVER (PARTITION BY t) AS group_size FROM d)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM g"""

SQL["op5_suffix_dedup"] = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
win AS (SELECT doc_id, i, substr(h, 2 * i + 1, 200) AS k FROM (SELECT doc_id, h, unnest(range(0, n - 99)) AS i FROM d WHERE n >= 100)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS r FROM win) WHERE r > 1),
run AS (SELECT doc_id, min(i) AS a, max(i) + 100 AS b FROM (
    SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM (
      SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100 THEN 0 ELSE 1 END AS new FROM again))
  GROUP BY doc_id, g),
part AS (SELECT doc_id, a, substr(h, 2 * coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) + 1,
    2 * (a - coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0))) AS kept
  FROM (SELECT doc_id, a, b FROM run UNION ALL SELECT doc_id, n, n + 1 FROM d) JOIN d USING (doc_id)),
whole AS (SELECT doc_id, string_agg(kept, '' ORDER BY a) AS kept FROM part GROUP BY doc_id),
gone AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans FROM run GROUP BY doc_id)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
  CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(kept)) AS kept_sha256
FROM d JOIN whole USING (doc_id) LEFT JOIN gone USING (doc_id)"""

SQL["op8_minhash_near_dedup"] = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS k
  FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
both_in AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both_n FROM s a JOIN s b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
link AS (SELECT a, b FROM both_in JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * both_n >= 85 * (x.n + y.n - both_n)),
edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach(node, least) AS (SELECT doc_id, doc_id FROM d
  UNION SELECT e.b, r.least FROM reach r JOIN edge e ON e.a = r.node WHERE r.least < e.b),
c AS (SELECT node AS doc_id, min(least) AS component_id FROM reach GROUP BY node)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM c LEFT JOIN n USING (doc_id)"""

_CHAR = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> {5 * (3 - i)}) & 31) + 1, 1)" for i in range(4))
SQL["op6_warc"] = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
part AS (SELECT page_id, k, CAST('0x' || substr(sha1(h), 5 * k + 1, 5) AS BIGINT) AS v
  FROM p, (SELECT unnest(generate_series(0, 7)) AS k)),
digest AS (SELECT page_id, string_agg({_CHAR}, '' ORDER BY k) AS d FROM part GROUP BY page_id),
f AS (SELECT page_id, h, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, d AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM f JOIN digest USING (page_id)"""

_ESCAPED = r"length(replace(replace({0}, '\', '\\'), '<', '\l'))"
SQL["op7_chat_format"] = rf"""
WITH c AS (SELECT conv_id, turn, role, coalesce(text, '') AS t FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || t || chr(10), '' ORDER BY turn, role, t)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(t) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN t END, '' ORDER BY turn, role, t), '')) AS loss_sha256,
  CAST(sum(15 + {_ESCAPED.format('role')} + {_ESCAPED.format('t')}) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id"""

SQL["op11_hard_negatives"] = """
WITH e AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pair AS (SELECT a.id AS a, b.id AS b, a.label = b.label AS same,
    CAST(list_dot_product(a.v, b.v) AS BIGINT) AS s
  FROM e a JOIN e b ON a.id % 100 = 0 AND a.id <> b.id),
pos AS (SELECT a, b, s FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS r FROM pair WHERE same) WHERE r <= 5),
neg AS (SELECT p.a, p.b AS p, p.s AS ps, n.b AS n, n.s AS ns, row_number() OVER (PARTITION BY p.a, p.b ORDER BY n.s DESC, n.b) AS r
  FROM pos p JOIN pair n ON p.a = n.a AND NOT n.same AND 30 * p.s <= 100 * n.s AND 100 * n.s <= 90 * p.s)
SELECT a AS anchor_id, p AS positive_id, CAST(r AS INTEGER) AS rank, n AS negative_id, ps AS positive_score, ns AS negative_score
FROM neg WHERE r <= 10"""

# a CRC-32 bit by bit: eight shifts a byte, its polynomial reflected
_CRC = """xor(list_reduce(list_transform(range(0, 8 * strlen(CAST(c AS VARCHAR))), lambda i: CAST(
    (ascii(substr(CAST(c AS VARCHAR), CAST(i // 8 + 1 AS BIGINT), 1)) >> (i % 8)) & 1 AS BIGINT)),
  lambda crc, bit: xor(crc >> 1, CASE WHEN xor(crc & 1, bit) = 1 THEN 3988292384 ELSE 0 END), CAST(4294967295 AS BIGINT)), 4294967295)"""
SQL["op13_prefix_trie"] = f"""
WITH turn AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS x,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT c, list(struct_pack(role := role, x := x) ORDER BY pos) AS w FROM turn GROUP BY c),
head AS (SELECT c, c - c % 5 AS base, w, {_CRC} % 9 AS h FROM own),
new AS (SELECT head.c, list_concat(coalesce(list_slice(own.w, 1, h), []), list_slice(head.w, h + 1, len(head.w))) AS w
  FROM head LEFT JOIN own ON own.c = head.base),
node AS (SELECT p, min(c) AS conv_id, count(*) AS n_convs, len(p) AS depth,
    sha256(coalesce(string_agg(c, ',' ORDER BY c) FILTER (WHERE n = len(p)), '')) AS ends_sha256
  FROM (SELECT c, len(w) AS n, list_slice(w, 1, d) AS p FROM (SELECT c, w, unnest(range(0, len(w) + 1)) AS d FROM new)) GROUP BY p),
kid AS (SELECT list_slice(p, 1, len(p) - 1) AS p, count(*) AS n FROM node WHERE len(p) > 0 GROUP BY ALL),
sub AS (SELECT up AS p, sum(CASE WHEN kid.n IS NULL THEN 1 ELSE 0 END) AS n_leaves, sum(saved) AS saved_tokens
  FROM (SELECT p, list_slice(p, 1, unnest(range(0, len(p) + 1))) AS up,
      CASE WHEN len(p) > 0 THEN (n_convs - 1) * strlen(p[len(p)].x) ELSE 0 END AS saved FROM node) AS below
  LEFT JOIN kid ON kid.p = below.p GROUP BY up)
SELECT node.conv_id, node.depth, above.conv_id AS parent_conv_id, node.n_convs, CAST(coalesce(kid.n, 0) AS BIGINT) AS n_children,
  CAST(sub.n_leaves AS BIGINT) AS n_leaves, CAST(sub.saved_tokens AS BIGINT) AS saved_tokens, node.ends_sha256
FROM node JOIN sub ON sub.p = node.p LEFT JOIN kid ON kid.p = node.p
LEFT JOIN node above ON node.depth > 0 AND above.p = list_slice(node.p, 1, node.depth - 1)"""
