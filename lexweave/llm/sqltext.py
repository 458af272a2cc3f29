"""DuckDB SQL of the operators that SQL can express."""

EXACT_DEDUP = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS size, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS norm FROM documents
), r AS (
  SELECT doc_id, norm, row_number() OVER w AS place, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size
  FROM d WINDOW w AS (PARTITION BY norm ORDER BY size DESC, doc_id)
)
SELECT doc_id, keep_id, group_size, place = 1 AS kept, sha256(norm) AS text_sha256 FROM r
"""

SEARCH = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents
), i AS (
  SELECT row_number() OVER () AS item, item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM benchmark
), it AS (
  SELECT item, item_id, term, count(*) AS times FROM (SELECT item, item_id, unnest(words) AS term FROM i) GROUP BY ALL
), total AS (SELECT count(*) AS n_docs, sum(len(words))::BIGINT AS n_terms FROM d WHERE len(words) > 0
), tf AS (
  SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(words) AS n, unnest(words) AS term FROM d) WHERE term IN (SELECT term FROM it) GROUP BY ALL
), w AS (
  SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS weight FROM tf, total GROUP BY term
), s AS (
  SELECT item, item_id, doc_id, sum(times * weight * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM tf JOIN it USING (term) JOIN w USING (term), total GROUP BY ALL
), r AS (
  SELECT item_id, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM s WHERE score > 0
)
SELECT * FROM r WHERE rank <= 10
"""

PREFIX_TRIE = """
WITH own AS (
  SELECT conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')} ORDER BY turn NULLS FIRST) AS turns FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), h AS (
  SELECT conv_id, turns, conv_id - conv_id % 5 AS base,
    xor(4294967295, list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda d: [ascii(d)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
      lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) ELSE xor(a >> 1, 3988292384 * (a & 1)) END)) % 9 AS h
  FROM own
), built AS (
  SELECT h.conv_id, list_concat(coalesce(b.turns, [])[1:h], h.turns[h + 1:]) AS turns FROM h LEFT JOIN own b ON b.conv_id = h.base
), member AS (
  SELECT conv_id, depth, len(turns) = depth AS ends, turns[1:depth] AS key FROM (SELECT conv_id, turns, unnest(range(len(turns) + 1)) AS depth FROM built)
), node AS (
  SELECT key, depth, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256,
    CASE WHEN depth > 0 THEN key[1:depth - 1] END AS parent, CASE WHEN depth > 0 THEN strlen(key[depth].text) ELSE 0 END AS bytes
  FROM member GROUP BY key, depth
), child AS (SELECT parent AS key, count(*) AS n FROM node WHERE depth > 0 GROUP BY parent
), up AS (
  SELECT v.key[1:a] AS key, sum(leaf)::BIGINT AS n_leaves, sum(saved)::BIGINT AS saved_tokens
  FROM (SELECT node.key, unnest(range(depth + 1)) AS a, (child.n IS NULL)::INTEGER AS leaf, (n_convs - 1) * bytes AS saved FROM node LEFT JOIN child ON child.key = node.key) v GROUP BY ALL
)
SELECT node.conv_id, node.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, node.n_convs, coalesce(child.n, 0) AS n_children, up.n_leaves, up.saved_tokens, node.ends_sha256
FROM node JOIN up ON up.key = node.key LEFT JOIN child ON child.key = node.key LEFT JOIN node p ON p.key = node.parent
"""
