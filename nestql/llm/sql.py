"""DuckDB SQL for the queries that SQL can express, written from the contract rather than from the operators."""

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP5 = rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
  SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END) AS s FROM words
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1
), links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id
  JOIN sizes p ON p.doc_id = a.doc_id JOIN sizes q ON q.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, p.n, q.n HAVING 100 * count(*) >= 85 * (p.n + q.n - count(*))
), both_ways AS (
  SELECT x, y FROM links UNION SELECT y, x FROM links
), reach AS (
  SELECT DISTINCT x AS node, x AS low FROM both_ways
  UNION SELECT b.y, r.low FROM reach r JOIN both_ways b ON b.x = r.node
), component AS (
  SELECT node, min(low) AS low FROM reach GROUP BY 1
)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, coalesce(c.low, d.doc_id) AS component_id,
  coalesce(c.low, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN sizes s USING (doc_id) LEFT JOIN component c ON c.node = d.doc_id
"""

#: Holds for pages that mark their article, whose blocks are h1 and p, as those of the test tables do.
OP1 = r"""
SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM (
  SELECT page_id, url, array_to_string(list_filter(list_transform(
    string_split_regex(regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1), '</?(?:p|h1)>'),
    lambda b: trim(regexp_replace(regexp_replace(replace(replace(replace(replace(
      regexp_replace(regexp_replace(b, '</?b>', '', 'g'), '<[^>]*>', ' ', 'g'),
      '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', ''''), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))),
    lambda b: b <> ''), chr(10) || chr(10)) AS text
  FROM pages)
"""

OP2 = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), marked AS (
  SELECT *, len(regexp_extract_all(text, '<\\*/?s>|\[\\*/?(?:INST|SYS|ANS|ESC|TURN)\\*(?:\]|)')) AS n_controls,
    CASE role WHEN 'user' THEN len('<s>[INST] ') + len(' [/INST]') WHEN 'system' THEN len('<s>[SYS] ') + len(' [/SYS]')
      ELSE len('<s>[ANS] ') + len(' </s>') END AS frame
  FROM rows
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(len(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(frame + len(text) + CASE WHEN n_controls > 0 THEN len('[ESC] ') + n_controls ELSE 0 END)::BIGINT AS formatted_chars
FROM marked GROUP BY conv_id
"""

OP6 = rf"""
WITH RECURSIVE parts AS (
  SELECT page_id, url, html, {_LOWER.format(r"regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1)")} AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path,
    regexp_extract(coalesce(url, ''), '(?s)^(.*?://)', 1) AS scheme, regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*[^?#]*([^#]*)', 1) AS query
  FROM pages
), rules(verdict, rhost, rpath) AS (
  VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
), linked AS (
  SELECT lower(scheme) || host || CASE WHEN path = '' THEN '/' ELSE path END || query AS src,
    regexp_extract(html, '(?is)<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*\bhref\s*=\s*["'']?([^"''\s>]*)', 1) AS dst
  FROM parts WHERE scheme <> '' AND html ILIKE '%canonical%'
), both_ways AS (
  SELECT src AS x, dst AS y FROM linked WHERE dst LIKE '%://%' UNION SELECT dst, src FROM linked WHERE dst LIKE '%://%'
), reach AS (
  SELECT DISTINCT x AS node, x AS other FROM both_ways
  UNION SELECT b.y, r.other FROM reach r JOIN both_ways b ON b.x = r.node
), fits AS (
  SELECT n.url, first(r.verdict ORDER BY len(rhost) + len(rpath) DESC) AS verdict, first(rhost || rpath ORDER BY len(rhost) + len(rpath) DESC) AS rule
  FROM (SELECT DISTINCT host, path, host || chr(0) || path AS url FROM parts
        UNION SELECT {_LOWER.format(r"regexp_extract(node, '://([^/?#]*)', 1)")}, regexp_extract(node, '://[^/?#]*([^?#]*)', 1), node FROM reach) n
  JOIN rules r ON (n.host = rhost OR ends_with(n.host, '.' || rhost)) AND starts_with(n.path, rpath) GROUP BY n.url
), tainted AS (
  SELECT DISTINCT r.node FROM reach r JOIN fits f ON f.url = r.other WHERE f.verdict = 'block'
)
SELECT page_id, host, path, f.rule, coalesce(f.verdict, CASE WHEN t.node IS NULL THEN 'allow' ELSE 'block' END) AS verdict
FROM parts p LEFT JOIN fits f ON f.url = p.host || chr(0) || p.path
LEFT JOIN tainted t ON t.node = lower(scheme) || host || CASE WHEN path = '' THEN '/' ELSE path END || query
"""

OP9 = rf"""
WITH doc AS (
  SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), item AS (
  SELECT item_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n, unnest(list_transform(range(1, greatest(2, len(w) - 11)), lambda i: array_to_string(w[i:i + least(13, len(w)) - 1], ' '))) AS g
  FROM item WHERE len(w) > 0
), sizes AS (
  SELECT DISTINCT n FROM windows
), grams AS (
  SELECT doc_id, s.n, unnest(range(1, len(w) - s.n + 2)) AS pos, unnest(list_transform(range(1, len(w) - s.n + 2), lambda i: array_to_string(w[i:i + s.n - 1], ' '))) AS g
  FROM doc, sizes s WHERE len(w) >= s.n
), hits AS (
  SELECT doc_id, pos, n, item_id FROM grams JOIN windows USING (n, g)
), counted AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + n)) AS p FROM hits) GROUP BY 1
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS listed FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM hits) GROUP BY 1
)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(c.n_hit, 0)::BIGINT AS n_hit, coalesce(i.n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(i.listed, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AND 20 * coalesce(c.n_hit, 0) >= len(d.w) AS contaminated
FROM doc d LEFT JOIN counted c USING (doc_id) LEFT JOIN items i USING (doc_id)
"""

OP10 = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS norm
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), links AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE a.norm > 0 AND b.norm > 0 AND list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.93
), reach AS (
  SELECT DISTINCT x AS node, x AS low FROM links
  UNION SELECT l.y, r.low FROM reach r JOIN links l ON l.x = r.node
), component AS (
  SELECT node, min(low) AS low FROM reach GROUP BY 1
), degree AS (
  SELECT x, count(*) AS n FROM links GROUP BY 1
)
SELECT e.vec_id, coalesce(d.n, 0)::BIGINT AS n_links, coalesce(c.low, e.vec_id) AS component_id, coalesce(c.low, e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN component c ON c.node = e.vec_id LEFT JOIN degree d ON d.x = e.vec_id
"""

ORACLES: dict[str, str] = {
    "op1_html_extraction": OP1,
    "op2_chat_formatting": OP2,
    "op5_minhash_dedup": OP5,
    "op6_url_filter": OP6,
    "op9_decontamination": OP9,
    "op10_embedding_dedup": OP10,
}
