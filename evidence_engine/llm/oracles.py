"""DuckDB statements that return the same rows as the queries of this subpackage."""

SUBSTRING_DEDUP = r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
n AS (SELECT doc_id, ws, CAST(len(ws) AS BIGINT) AS n_words FROM w),
win AS (SELECT doc_id, t.i AS i, array_to_string(ws[t.i:t.i + 12], ' ') AS s FROM n, LATERAL (SELECT unnest(range(1, n_words - 11)) AS i) t),
firsts AS (SELECT s, min(doc_id) AS d FROM win GROUP BY s),
rem AS (SELECT DISTINCT win.doc_id, win.i + r.k AS p FROM win JOIN firsts USING (s), (SELECT unnest(range(0, 13)) AS k) r WHERE firsts.d < win.doc_id),
words AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM n),
marked AS (SELECT words.doc_id, word, words.p, rem.p IS NOT NULL AS gone FROM words LEFT JOIN rem ON words.doc_id = rem.doc_id AND words.p = rem.p),
agg AS (SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed, string_agg(word, ' ' ORDER BY p) FILTER (WHERE NOT gone) AS kept FROM marked GROUP BY doc_id)
SELECT n.doc_id, n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM n LEFT JOIN agg USING (doc_id)
"""

TOPK_SEARCH = r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""

#: Mined rules by brute force: every combination of the tokens of every labelled URL is counted.
URL_RULES = r"""
WITH RECURSIVE p AS (
  SELECT page_id, url, CASE WHEN contains(url, '://') THEN substring(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (
  SELECT page_id, url, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM p),
t AS (
  SELECT page_id, host, path, list_sort(list_distinct(coalesce(
    list_transform(list_filter(string_split(host, '.'), lambda x: x <> ''), lambda x: 'h:' || regexp_replace(x, '[0-9]+', '0', 'g'))
    || list_transform(list_filter(string_split(path, '/'), lambda x: x <> ''), lambda x: 'p:' || regexp_replace(x, '[0-9]+', '0', 'g'))
    || list_transform(list_filter(list_transform(string_split(regexp_extract(url, '\?([^#]*)', 1), '&'), lambda x: regexp_extract(x, '^[^=]*')), lambda x: x <> ''), lambda x: 'q:' || x), []))) AS ts
  FROM h),
marks AS (SELECT doc_id, coalesce(min(quality) = 0, false) OR coalesce(max(toxic) = 1, false) AS bad FROM labels GROUP BY doc_id),
lab AS (
  SELECT page_id, bad FROM t JOIN marks ON marks.doc_id = TRY_CAST(nullif(regexp_extract(path, '([0-9]{1,18})[^0-9]*$', 1), '') AS BIGINT)),
least AS (SELECT greatest(20, CAST(ceil(0.002::DOUBLE * count(*)) AS BIGINT)) AS k FROM lab),
sub AS (
  SELECT page_id, i AS last, ts[i] AS s, 1 AS size FROM t, LATERAL (SELECT unnest(range(1, len(ts) + 1)) AS i)
  UNION ALL
  SELECT sub.page_id, j, sub.s || ' ' || ts[j], size + 1 FROM sub JOIN t USING (page_id), LATERAL (SELECT unnest(range(sub.last + 1, len(ts) + 1)) AS j) WHERE size < 4),
counted AS (
  SELECT s, count(*) AS n, count(*) FILTER (WHERE bad) AS b FROM sub JOIN lab USING (page_id) GROUP BY s),
rules AS (
  SELECT s, bad, n, hit FROM (SELECT s, true AS bad, n::DOUBLE AS n, b::DOUBLE AS hit FROM counted UNION ALL SELECT s, false, n, n - b FROM counted), least,
    (SELECT count(*)::DOUBLE AS rows, (count(*) FILTER (WHERE bad))::DOUBLE AS bads FROM lab), LATERAL (SELECT CASE WHEN bad THEN bads ELSE rows - bads END AS base, hit * rows - n * base AS gain)
  WHERE hit >= k AND hit >= 0.6::DOUBLE * n AND gain > 0 AND gain * gain > n * base * (rows - base) * 25),
best AS (
  SELECT page_id, max({'bad': bad, 'c': CAST(floor(hit * 1000000 / n::DOUBLE + 0.5) AS BIGINT), 'n': n::BIGINT}) AS m FROM sub JOIN rules USING (s) GROUP BY page_id),
fixed(no, h, p, v) AS (VALUES (1, 'com', '/', 'allow'), (2, 'example.com', '/en/', 'block'), (3, 'www.example.com', '/en/', 'allow'), (4, 'net', '/es/', 'block'), (5, 'net', '/fr/', 'block')),
hand AS (
  SELECT page_id, arg_max(fixed.h || p, (length(fixed.h || p), no)) AS rule, arg_max(v, (length(fixed.h || p), no)) AS v
  FROM t JOIN fixed ON (t.host = fixed.h OR ends_with(t.host, '.' || fixed.h)) AND starts_with(t.path, p) GROUP BY page_id)
SELECT t.page_id, host, path, rule, coalesce(v, CASE WHEN m.bad THEN 'block' ELSE 'allow' END) AS verdict,
  CASE WHEN m IS NULL THEN NULL WHEN m.bad THEN 'label:bad' ELSE 'label:good' END AS mined, m.c AS confidence, m.n AS n
FROM t LEFT JOIN best USING (page_id) LEFT JOIN hand USING (page_id)
"""

#: Every group's share of every kept term, absent ones included.
DIVERGENCE = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
t AS (
  SELECT r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term FROM t GROUP BY ALL HAVING count(DISTINCT r) >= 3),
size AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS c FROM t JOIN kept USING (lang, term) GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
total AS (SELECT lang, source, sum(c) AS n FROM c GROUP BY ALL),
shares AS (
  SELECT g.lang, g.source, kept.term, coalesce(c.c, 0) AS c, CAST(1 + (1000000000::HUGEINT * (coalesce(c.c, 0) + 1)) // (coalesce(total.n, 0) + size.v) AS BIGINT) AS p
  FROM g JOIN kept USING (lang) JOIN size USING (lang) LEFT JOIN total ON total.lang = g.lang AND total.source = g.source
  LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
whole AS (
  SELECT lang, term, CAST(1 + (1000000000::HUGEINT * (sum(c) + 1)) // (any_value(n) + any_value(v)) AS BIGINT) AS q
  FROM c JOIN size USING (lang) JOIN (SELECT lang, sum(n) AS n FROM total GROUP BY lang) USING (lang) GROUP BY lang, term),
sums AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
rows AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums ON sums.lang = a.lang AND sums.source = a.source AND sums.item = b.source
  UNION ALL
  SELECT s.lang, s.source, 'term', s.term, CAST((p - q) * (p - q) // q AS BIGINT) FROM shares s JOIN whole USING (lang, term) WHERE s.c > 0 AND p > q)
SELECT lang, source, part, item, value, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM rows)
WHERE part = 'pair' OR rank <= 200
"""


def _compression(rounds: int = 4, entries: int = 256, parts: int = 4) -> str:
    """Each round's assignment and update as common table expressions, all distances counted."""
    steps = [f"""v AS (
  SELECT row_number() OVER (ORDER BY vec_id, embedding) AS r, vec_id, label, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT r, k AS part, e[k * (len(e) // {parts}) + 1 : (k + 1) * (len(e) // {parts})] AS x FROM v, (SELECT unnest(range({parts})) AS k)),
book0 AS (SELECT part, r - 1 AS entry, x AS c FROM p WHERE r <= {entries})"""]
    for n in range(rounds + 1):
        steps.append(f"""near{n} AS (
  SELECT r, part, min({{'d': CAST(list_inner_product(x, x) + list_inner_product(c, c) - 2 * list_inner_product(x, c) AS BIGINT), 'entry': entry}}) AS m FROM p JOIN book{n} USING (part) GROUP BY r, part)""")
        if n < rounds:
            steps.append(f"""mean{n} AS (
  SELECT part, entry, list(m ORDER BY i) AS c FROM (
    SELECT part, entry, i, floor(sum(x) / count(*)) AS m FROM (SELECT part, m.entry AS entry, unnest(x) AS x, generate_subscripts(x, 1) AS i FROM near{n} JOIN p USING (r, part)) GROUP BY part, entry, i)
  GROUP BY part, entry),
book{n + 1} AS (SELECT b.part, b.entry, coalesce(mean{n}.c, b.c) AS c FROM book{n} b LEFT JOIN mean{n} ON mean{n}.part = b.part AND mean{n}.entry = b.entry)""")
    return "WITH " + ",\n".join(steps) + f""",
coded AS (SELECT r, string_agg(printf('%02x', m.entry), '' ORDER BY part) AS code, CAST(sum(m.d) AS BIGINT) AS error FROM near{rounds} GROUP BY r),
digest AS (SELECT sha256(string_agg(CAST(CAST(y AS BIGINT) AS VARCHAR), ',' ORDER BY part, entry, i)) AS s FROM (SELECT part, entry, unnest(c) AS y, generate_subscripts(c, 1) AS i FROM book{rounds}))
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, s AS codebooks_sha256 FROM coded JOIN v USING (r), digest
"""


CODE_COMPRESSION = _compression()
