"""DuckDB SQL for the queries of this subpackage that SQL can express on whole tables.

The others are tested against brute force, public libraries or held-out accuracy in tests/llm.
"""

_BLANK = "[\\x20\\x09-\\x0D]"

OP3 = f"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_BLANK}+'), lambda w: w <> '') AS w
  FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))) END AS s
  FROM words
), shingles AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets
), pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS both_
  FROM shingles a JOIN shingles b ON a.x = b.x AND a.doc_id < b.doc_id
  GROUP BY ALL
), links AS (
  SELECT a, b FROM pairs WHERE 100 * both_ >= 75 * (na + nb - both_)
), ways AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT r.doc_id, w.b FROM reach r JOIN ways w ON w.a = r.other
), least AS (
  SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id
)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, l.component_id, s.doc_id = l.component_id AS kept
FROM sets s JOIN least l USING (doc_id)
"""

OP4 = f"""
WITH n AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '{_BLANK}', '', 'g') AS k FROM documents
), r AS (
  SELECT doc_id, k, row_number() OVER w AS rn, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY k) AS group_size
  FROM n WINDOW w AS (PARTITION BY k ORDER BY length(t) DESC, doc_id)
)
SELECT doc_id, keep_id, group_size, rn = 1 AS kept, sha256(k) AS text_sha256 FROM r
"""

OP7 = r"""
WITH p AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), q AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p
), r AS (
  SELECT *, CASE
    WHEN regexp_matches(host, '(^|\.)example\.org$') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN regexp_matches(host, '(^|\.)example\.org$') AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN regexp_matches(host, '(^|\.)com$') AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN regexp_matches(host, '(^|\.)com$') AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN regexp_matches(host, '(^|\.)org$') AND starts_with(path, '/') THEN 'org/' END AS rule FROM q
)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN host = '' THEN 'block'
    WHEN regexp_matches(host || path, '(?s)^(.*[./])?(login|signin|signup|logout|cart|checkout|adserver|tracker|casino|porn|wp-login\.php|wp-admin/[^.]+\.php|xmlrpc\.php|cgi-bin/[^/]+\.(cgi|pl)|(tag|category)/[^/]+/page/[0-9]+|calendar/[0-9]{4}/[0-9]{1,2}|user/[^/]+/(edit|password)|search/[^/]+/[0-9]+|ads?[0-9]*\.[^/]+/banner|api/v[0-9]+/[^/]+|feed/(rss|atom))([./].*)?$') THEN 'block'
    ELSE 'allow' END AS verdict FROM r
"""

OP11 = r"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), w AS (
  SELECT id, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
), kept AS (
  SELECT lang, term, count(*) AS n FROM w GROUP BY ALL HAVING count(DISTINCT id) >= 10
), langs AS (
  SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY ALL
), c AS (
  SELECT w.lang, w.source, w.term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY ALL
), totals AS (
  SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL
), grp AS (
  SELECT g.lang, g.source, coalesce(t.total, 0) AS total FROM (SELECT DISTINCT lang, source FROM d) g LEFT JOIN totals t USING (lang, source)
), p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (g.total + 2 * l.v)::HUGEINT AS p, 1 + (1000000000::HUGEINT * (k.n + 2)) // (l.total + 2 * l.v)::HUGEINT AS q
  FROM grp g JOIN langs l USING (lang) JOIN kept k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(any_value(x.value), 0) AS value
  FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL) x
    ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  GROUP BY ALL
), parts AS (
  SELECT lang, source, 'pair' AS part, item, value FROM pairs
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM p WHERE n > 0 AND p > q
), r AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM parts
)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM r WHERE part = 'pair' OR rank <= 10
"""

OP12 = r"""
WITH p AS (
  SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS h, sha256(coalesce(html, '')) AS d, strftime(TIMESTAMP '2024-01-01' + to_seconds(page_id), '%Y-%m-%dT%H:%M:%SZ') AS date FROM pages
), f AS (
  SELECT *, CASE WHEN strlen(h) >= 100 AND page_id > min(page_id) OVER (PARTITION BY h) THEN min(page_id) OVER (PARTITION BY h) END AS first,
    regexp_extract(url, '(?s)^.*?://([^#]*)', 1) AS rest FROM p
), k AS (
  SELECT *, CASE WHEN contains(url, '://') THEN
      array_to_string(list_reverse(string_split(translate(regexp_extract(rest, '^([^/?]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '.')), ',') || ')'
      || coalesce(nullif(regexp_extract(rest, '(?s)^[^/?]*(.*)$', 1), ''), '/') ELSE url END AS url_key FROM f
)
SELECT page_id, strlen(h)::BIGINT AS payload_bytes, d AS payload_digest, CASE WHEN first IS NULL THEN 'response' ELSE 'revisit' END AS record_type, first AS refers_to,
  url_key, date, row_number() OVER (ORDER BY url_key, date, page_id) AS place FROM k
"""

OP13 = f"""
WITH w AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
    list_filter(regexp_split_to_array(coalesce(text, ''), '{_BLANK}+'), lambda x: x <> '') AS w FROM documents
), f AS (
  SELECT part, len(w) < 50 AS a, 100 * len(list_distinct(w)) < 65 * len(w) AS b, 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) AS c,
    regexp_matches(t, '[#$%&*|]') AS d, coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS e,
    coalesce(doc_id IN (SELECT doc_id FROM labels WHERE quality = 1), false) AS good, coalesce(doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1), false) AS toxic FROM w
), m AS (
  SELECT part, a::INT + 2 * b::INT + 4 * c::INT + 8 * d::INT + 16 * e::INT AS failed, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY ALL
), l AS (
  SELECT chr(65 + i::INT) AS x, 1 << i::INT AS bit FROM range(5) r(i)
), o AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM l a, l b, l c, l d, l e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), s AS (
  SELECT filter_order, step::INT AS step, bits[step] AS bit, coalesce(list_sum(bits[1 : step - 1]), 0)::BIGINT AS earlier FROM o, range(1, 6) r(step)
), r AS (
  SELECT part, filter_order, step, bit,
    sum(n) FILTER (failed & (earlier | bit) = 0) AS kept, sum(n) FILTER (failed & bit > 0 AND failed & earlier = 0) AS removed, sum(n) FILTER (failed & bit > 0 AND failed & earlier > 0) AS redundant,
    sum(n) FILTER (failed = bit) AS unique_fails, sum(good) FILTER (failed & bit > 0 AND failed & earlier = 0) AS good_lost, sum(toxic) FILTER (failed & bit > 0 AND failed & earlier = 0) AS toxic_lost
  FROM m, s GROUP BY ALL
)
SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant,
  coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
  coalesce(sum(removed) OVER (PARTITION BY part, bit), 0)::BIGINT AS shapley
FROM r
"""

ORACLES = {"op3_near_dup": OP3, "op4_exact_dedup": OP4, "op7_url_filter": OP7, "op11_source_divergence": OP11, "op12_warc": OP12, "op13_filter_audit": OP13}
