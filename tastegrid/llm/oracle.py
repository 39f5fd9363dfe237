"""SQL for the text queries that SQL can express."""

from __future__ import annotations

ORACLE: dict[str, str] = {}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "coalesce(regexp_extract_all(" + _LOWER + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), [])"

ORACLE["op3_positional"] = f"""
WITH d AS (SELECT doc_id, {_WORDS.format('text')} AS w FROM documents),
b AS (SELECT item_id, {_WORDS.format('text')} AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, w[s : s + 9] AS g, len(w[s : s + 9]) AS n
  FROM b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) t(s) WHERE len(w) > 0
),
runs AS (
  SELECT doc_id, s, n, w[s : s + n - 1] AS g
  FROM d, (SELECT DISTINCT n FROM win) l, unnest(range(1, len(w) - n + 2)) t(s) WHERE len(w) >= n
),
hit AS (SELECT doc_id, s, r.n, item_id FROM runs r JOIN win ON r.n = win.n AND r.g = win.g),
placed AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hit) GROUP BY doc_id),
named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hit) GROUP BY doc_id
)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN placed USING (doc_id) LEFT JOIN named USING (doc_id)
"""

ORACLE["op8_e8"] = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x != 0)) > 0
),
link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id != b.vec_id
  WHERE list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e)) / sqrt(list_dot_product(b.e, b.e)) >= 0.93
),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a)
SELECT e.vec_id, coalesce(n, 0) AS n_links, c AS component_id, e.vec_id = c AS kept
FROM embeddings e
LEFT JOIN (SELECT a, count(*) AS n FROM link GROUP BY a) l ON l.a = e.vec_id
JOIN (SELECT a, min(b) AS c FROM reach GROUP BY a) r ON r.a = e.vec_id
"""

# Links are followed a hundred times; scores are compared to five digits.
ORACLE["op6_host_trust"] = r"""
WITH RECURSIVE cut AS (
  SELECT page_id, html, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages
),
named AS (
  SELECT page_id, html,
    coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
  FROM cut
),
rules(verdict, h, p) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
  ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
site AS (
  SELECT host, path, arg_max(h || p, length(h || p)) AS rule, arg_max(verdict, length(h || p)) AS by_rule
  FROM (SELECT DISTINCT host, path FROM named) JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
  GROUP BY host, path
),
judged AS (SELECT named.*, rule, by_rule FROM named LEFT JOIN site USING (host, path)),
seed AS (
  SELECT kind, host, CASE kind WHEN 'trust' THEN good ELSE bad END AS s
  FROM (SELECT host, count(*) FILTER (by_rule = 'allow') / count(*) AS good, count(*) FILTER (by_rule = 'block') / count(*) AS bad
        FROM judged WHERE host != '' GROUP BY host), (VALUES ('trust'), ('distrust')) k(kind)
),
refs AS (SELECT host AS src, unnest(regexp_extract_all(html, '(?i)\shref\s*=\s*["'']?\s*([^"''\s>]+)', 1)) AS t FROM named WHERE host != ''),
ends AS (
  SELECT src, CASE WHEN regexp_matches(t, '^([A-Za-z][A-Za-z0-9+.-]*:)?//')
    THEN translate(regexp_extract(substr(t, instr(t, '//') + 2), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')
    ELSE src END AS dst FROM refs
),
link AS (SELECT src, dst, count(*) AS n FROM ends WHERE dst != '' GROUP BY src, dst),
arc AS (
  SELECT 'trust' AS kind, src AS host, dst AS t, n / sum(n) OVER (PARTITION BY src) AS share FROM link UNION ALL
  SELECT 'distrust', dst, src, n / sum(n) OVER (PARTITION BY dst) FROM link
),
flow(k, kind, host, x, y) AS (
  SELECT 0, kind, host, s, 1.0::DOUBLE FROM seed
  UNION ALL
  SELECT k, kind, host, sum(x), sum(y) FROM (
    SELECT k + 1 AS k, arc.kind, arc.t AS host, x * share * 0.85 AS x, y * share * 0.85 AS y
    FROM flow JOIN arc ON flow.kind = arc.kind AND flow.host = arc.host WHERE k < 100
    UNION ALL
    SELECT m.k + 1, seed.kind, seed.host, s * 0.15, 0.15 FROM seed, (SELECT DISTINCT k FROM flow WHERE k < 100) m
  ) GROUP BY k, kind, host
),
part AS (  -- a host's score over that of a seed of 1 everywhere, at least its own seed
  SELECT host, kind, x, greatest(coalesce(s, 0), coalesce(x / nullif(y, 0), 0)) AS part
  FROM flow LEFT JOIN seed USING (kind, host) WHERE k = 100
),
score AS (
  SELECT host, coalesce(sum(x) FILTER (kind = 'trust'), 0) AS trust, coalesce(sum(x) FILTER (kind = 'distrust'), 0) AS distrust,
    coalesce(sum(part) FILTER (kind = 'distrust'), 0) - coalesce(sum(part) FILTER (kind = 'trust'), 0) AS more
  FROM part GROUP BY host
)
SELECT page_id, judged.host, path, rule,
  coalesce(by_rule, CASE WHEN round(coalesce(more, 0) - 0.5, 9) > 0 THEN 'block' ELSE 'allow' END) AS verdict,
  round(coalesce(trust, 0), 5)::DOUBLE AS trust, round(coalesce(distrust, 0), 5)::DOUBLE AS distrust
FROM judged LEFT JOIN score ON score.host = judged.host
"""

ORACLE["op11_stripes"] = f"""
WITH piece AS (
  SELECT doc_id, lang, unnest(string_split_regex({_LOWER.format('text')}, '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM (SELECT doc_id, coalesce(lang, 'und') AS lang, text FROM documents)
),
cut AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM piece),
place AS (SELECT lang, unnest(list_zip(w, w[2:], w[3:])) AS t FROM cut WHERE len(w) > 0),
words AS (SELECT lang, t[1] AS w1, t[2] AS w2, t[3] AS w3 FROM place),
gram AS (
  SELECT lang, 1 AS k, [w1] AS g FROM words UNION ALL
  SELECT lang, 2, [w1, w2] FROM words WHERE w2 IS NOT NULL UNION ALL
  SELECT lang, 3, [w1, w2, w3] FROM words WHERE w3 IS NOT NULL
),
f AS (SELECT lang, k, array_to_string(g, ' ') AS phrase, any_value(g) AS g, count(*) AS f, lang || chr(9) || phrase AS id FROM gram GROUP BY lang, k, phrase),
total AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
cand AS (SELECT lang, k, phrase, g, f AS a FROM f WHERE k > 1 AND f >= 10),
longer AS (
  SELECT lang, phrase, max(a) AS a FROM (
    SELECT lang, array_to_string(g[1:2], ' ') AS phrase, a FROM cand WHERE k = 3 UNION ALL
    SELECT lang, array_to_string(g[2:3], ' '), a FROM cand WHERE k = 3
  ) GROUP BY lang, phrase
),
parts AS (
  SELECT c.lang, c.phrase, c.a, j,
    lang || chr(9) || array_to_string(g[1:j], ' ') AS head, lang || chr(9) || array_to_string(g[j + 1 :], ' ') AS rest
  FROM cand c LEFT JOIN longer USING (lang, phrase), (VALUES (1), (2)) t(j)
  WHERE j < k AND coalesce(100 * longer.a < 50 * c.a, true)
),
scored AS (
  SELECT parts.lang, parts.phrase, a, j, x.f AS l, y.f AS r, (1000000::HUGEINT * a * a // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM parts JOIN f x ON x.id = head JOIN f y ON y.id = rest
),
least AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM least JOIN total USING (lang)
QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000
"""
