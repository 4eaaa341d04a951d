"""DuckDB SQL for the registered queries that SQL can express."""

from __future__ import annotations

OP1 = r"""
WITH d AS (
  SELECT doc_id, [x FOR x IN string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+') IF x <> ''] AS w FROM documents
), windows AS (
  SELECT doc_id, s, array_to_string(w[s:s + 12], ' ') AS win FROM d, unnest(range(1, len(w) - 11)) AS t(s)
), firsts AS (
  SELECT win, min(doc_id) AS owner FROM windows GROUP BY win
), gone AS (
  SELECT DISTINCT doc_id, s + k AS p
  FROM windows JOIN firsts USING (win), range(0, 13) AS r(k) WHERE owner < doc_id
), words AS (
  SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d
), kept AS (
  SELECT words.doc_id, count(gone.p) AS n_removed,
         sha256(coalesce(string_agg(word, ' ' ORDER BY words.p) FILTER (gone.p IS NULL), '')) AS kept_sha256
  FROM words LEFT JOIN gone ON gone.doc_id = words.doc_id AND gone.p = words.p GROUP BY words.doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(kept_sha256, sha256('')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

OP3 = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
    AND len([x FOR x IN embedding IF x <> 0]) > 0
), u AS (
  SELECT vec_id, e, sqrt(list_inner_product(e, e)) AS n FROM v
), link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id
  WHERE list_inner_product(a.e, b.e) / (a.n * b.n) >= 0.95
), reach(a, c) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.c
), groups AS (
  SELECT a AS vec_id, min(c) AS component_id FROM reach GROUP BY a
), counts AS (
  SELECT a AS vec_id, count(*) AS n_links FROM link GROUP BY a
)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM groups LEFT JOIN counts USING (vec_id)
"""

OP4 = """
WITH v AS (
  SELECT vec_id, [floor(256 * x::DOUBLE) FOR x IN embedding] AS w FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.w, c.w)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM scored
)
SELECT query_id, place::INTEGER AS rank, vec_id, score FROM ranked WHERE place <= 5
"""

OP5 = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, [x FOR x IN string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') IF x <> ''] AS w
  FROM documents
), shingles AS MATERIALIZED (
  SELECT DISTINCT doc_id, md5(array_to_string(w[s:s + 2], ' ')) AS g FROM d, unnest(range(1, len(w) - 1)) AS t(s) WHERE len(w) >= 3
  UNION ALL
  SELECT doc_id, md5(array_to_string(w, ' ')) FROM d WHERE len(w) BETWEEN 1 AND 2
), sizes AS MATERIALIZED (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), often AS (
  SELECT g FROM shingles GROUP BY g HAVING count(*) > 1
), common AS (
  SELECT doc_id, g FROM shingles JOIN often USING (g)
), shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM common a JOIN common b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2
), link AS MATERIALIZED (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * shared.n >= 90 * (x.n + y.n - shared.n)
), reach(a, c) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.c
)
SELECT reach.a AS doc_id, coalesce(any_value(sizes.n), 0)::BIGINT AS n_shingles, min(reach.c) AS component_id
FROM reach LEFT JOIN sizes ON sizes.doc_id = reach.a GROUP BY reach.a
"""

TWO_LABELS = (
    "'ac.uk', 'co.in', 'co.jp', 'co.kr', 'co.nz', 'co.uk', 'co.za', 'com.ar', 'com.au', 'com.br', 'com.cn', 'com.mx', 'com.tr', "
    "'com.tw', 'gov.au', 'gov.uk', 'ne.jp', 'net.au', 'or.jp', 'org.au', 'org.uk'"
)


def _strength(level: str) -> str:
    return f"""SELECT 1 / least(greatest(coalesce(
      sum((bad - n * prior) ** 2 - n * prior * (1 - prior)) / nullif(sum(n * (n - 1) * prior * (1 - prior)), 0), 0), 1 / 1001), 1 / 2) - 1 AS k
    FROM {level}"""


OP9 = f"""
WITH p AS (
  SELECT page_id, url,
    coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), l AS (
  SELECT doc_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY doc_id
), outcomes AS (
  SELECT page_id, max(bad) AS bad
  FROM (SELECT page_id, try_cast(regexp_extract(path, '^/[^/]*/([0-9]+)', 1) AS BIGINT) AS doc_id FROM p) JOIN l USING (doc_id) GROUP BY page_id
), counted AS (
  SELECT host, count(bad)::DOUBLE AS n, coalesce(sum(bad), 0)::DOUBLE AS bad FROM p LEFT JOIN outcomes USING (page_id) GROUP BY host
), suffixed AS (
  SELECT *, string_split(host, '.') AS parts,
    CASE WHEN array_to_string(string_split(host, '.')[-2:], '.') IN ({TWO_LABELS}) THEN array_to_string(string_split(host, '.')[-2:], '.')
         ELSE string_split(host, '.')[-1] END AS suffix
  FROM counted
), hosts AS (
  SELECT host, n, bad, suffix, CASE WHEN len(parts) <= len(string_split(suffix, '.')) + 1 THEN host
    ELSE array_to_string(parts[-(len(string_split(suffix, '.')) + 1):], '.') END AS domain
  FROM suffixed
), domain_counts AS (
  SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY ALL
), suffix_counts AS (
  SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM domain_counts GROUP BY ALL
), suffixes AS (
  SELECT *, (SELECT (sum(bad) + 0.5) / (sum(n) + 1) FROM suffix_counts) AS prior FROM suffix_counts
), k0 AS ({_strength('suffixes')}),
domains AS (
  SELECT d.domain, d.suffix, d.n, d.bad, (k * s.prior + s.bad) / (k + s.n) AS prior
  FROM domain_counts d JOIN suffixes s USING (suffix), k0
), k1 AS ({_strength('domains')}),
leaves AS (
  SELECT h.host, h.n, h.bad, (k * d.prior + d.bad) / (k + d.n) AS prior FROM hosts h JOIN domains d USING (domain, suffix), k1
), k2 AS ({_strength('leaves')}),
posterior AS (
  SELECT host, (k * prior + bad) / (k + n) AS mean, n + k AS weight FROM leaves, k2
), verdicts AS (
  SELECT host, CASE WHEN mean - 1.645 * sqrt(mean * (1 - mean) / (weight + 1)) > 0.5 THEN 'block' ELSE 'allow' END AS own FROM posterior
), ruled AS (
  SELECT p.*, CASE
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM p
)
SELECT page_id, host, path, rule, CASE rule
    WHEN 'example.net/en/' THEN 'allow' WHEN 'example.com/de/' THEN 'block' WHEN 'org/fr/' THEN 'allow' WHEN 'net/' THEN 'block'
    ELSE own END AS verdict
FROM ruled JOIN verdicts USING (host)
"""


OP11 = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS n
  FROM documents
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), common AS (
  SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10
)
SELECT doc_id, count(*) AS n_lines, count(common.key) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (common.key IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN common USING (key) GROUP BY doc_id
"""


OP12 = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         [floor(256 * x::DOUBLE) FOR x IN embedding] AS w
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.w, b.w)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, positive_id, positive_score, n.vec_id AS negative_id, n.score AS negative_score,
       (row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY n.score DESC, n.vec_id))::INTEGER AS rank
FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same
  AND 50 * positive_score <= 100 * n.score AND 100 * n.score <= 95 * positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY n.score DESC, n.vec_id) <= 3
"""


OP13 = r"""
WITH turns AS (
  SELECT conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')} ORDER BY turn NULLS FIRST) AS t
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), counted AS (
  SELECT *, xor(list_reduce(flatten([[4294967295], flatten([[ascii(c), -1, -1, -1, -1, -1, -1, -1, -1] FOR c IN string_split(conv_id::VARCHAR, '')])])::BIGINT[],
    lambda s, x: CASE WHEN x >= 0 THEN xor(s, x) ELSE xor(s >> 1, 3988292384 * (s & 1)) END), 4294967295) % 4 AS h
  FROM turns
), rebuilt AS (
  SELECT c.conv_id, list_concat(coalesce(o.t[1:c.h], []), c.t[c.h + 1:]) AS t
  FROM counted c LEFT JOIN turns o ON o.conv_id = c.conv_id - c.conv_id % 20
), members AS (
  SELECT conv_id, d, t[1:d] AS node, len(t) = d AS ends FROM rebuilt, unnest(range(0, len(t) + 1)) AS r(d)
), nodes AS (
  SELECT d, node, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256,
    CASE WHEN d = 0 THEN 0 ELSE (count(*) - 1) * len([x FOR x IN string_split_regex(node[d].text, '[\x20\x09-\x0D]+') IF x <> '']) END AS saved
  FROM members GROUP BY d, node
), children AS (
  SELECT d - 1 AS d, node[1:d - 1] AS node, count(*) AS n FROM nodes WHERE d > 0 GROUP BY ALL
), below AS (
  SELECT up.d AS d, n.node[1:up.d] AS node, sum(saved) AS saved, count(*) FILTER (c.n IS NULL) AS leaves
  FROM nodes n LEFT JOIN children c USING (d, node), unnest(range(0, n.d + 1)) AS up(d) GROUP BY ALL
)
SELECT n.conv_id, n.d AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n, 0)::BIGINT AS n_children,
  b.leaves::BIGINT AS n_leaves, b.saved::BIGINT AS saved_tokens, n.ends_sha256
FROM nodes n JOIN below b USING (d, node) LEFT JOIN children c USING (d, node)
LEFT JOIN nodes p ON p.d = n.d - 1 AND p.node = n.node[1:n.d - 1]
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_substring_dedup": OP1, "op3_embedding_dedup": OP3, "op4_topk_search": OP4, "op5_jaccard_join": OP5,
        "op9_url_reputation": OP9, "op11_line_dedup": OP11, "op12_hard_negatives": OP12,
        "op13_prefix_trie": OP13,
    }
