"""DuckDB texts of the queries that SQL can express."""

from nextcover.llm.sharding import LIMIT_BYTES

SQL: dict[str, str] = {}

# the depth of a document's shard is the first at which its prefix's bytes fit
SQL["op5_extendible_shards"] = f"""
WITH sized AS (
  SELECT doc_id, coalesce(octet_length(encode(text)), 0)::BIGINT AS n_bytes,
         ('0x' || substr(md5(coalesce('=' || doc_id::VARCHAR, '-')), 1, 15))::BIGINT AS hash
  FROM documents),
sums AS (
  SELECT d, hash >> (60 - d) AS prefix, sum(n_bytes) AS bytes
  FROM sized, (SELECT unnest(generate_series(0, 40))::INTEGER AS d) GROUP BY 1, 2),
placed AS (
  SELECT s.doc_id, s.n_bytes, s.hash, min(b.d) AS d
  FROM sized s JOIN sums b ON b.prefix = s.hash >> (60 - b.d) AND b.bytes <= {LIMIT_BYTES} GROUP BY ALL)
SELECT doc_id, n_bytes, d::VARCHAR || '-' || (hash >> (60 - d))::VARCHAR AS shard, d::BIGINT AS shard_depth
FROM placed
"""

WORDS = r"regexp_extract_all(lower(coalesce(text, '')), '[0-9a-z\x{80}-\x{10FFFF}]+')"

SQL["op3_jaccard_forest_join"] = f"""
WITH RECURSIVE texts AS (SELECT doc_id, {WORDS} AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 4], ' ') END AS s
  FROM texts, unnest(range(1, greatest(len(w) - 3, 2))) AS t(i) WHERE len(w) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1),
common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (
  SELECT x, y FROM common c JOIN sizes a ON a.doc_id = x JOIN sizes b ON b.doc_id = y
  WHERE 10 * c.n >= 8 * (a.n + b.n - c.n)),
reach AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y),
groups AS (SELECT x, min(y) AS least FROM reach GROUP BY 1),
degree AS (SELECT x, count(*) AS n FROM links GROUP BY 1),
same AS (SELECT w, min(doc_id) AS text_id FROM texts WHERE len(w) > 0 GROUP BY 1)
SELECT t.doc_id, least(t.doc_id, coalesce(g.least, t.doc_id)) AS class_id, coalesce(s.text_id, t.doc_id) AS text_id,
       coalesce(d.n, 0)::BIGINT AS n_links
FROM texts t LEFT JOIN groups g ON g.x = t.doc_id LEFT JOIN degree d ON d.x = t.doc_id LEFT JOIN same s ON s.w = t.w
"""

SQL["op6_exact_top_k"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS query_id, b.vec_id, list_dot_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q) WHERE a.vec_id % 50 = 0),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM scored)
SELECT query_id, r::INTEGER AS rank, vec_id, score FROM ranked WHERE r <= 5
"""

ASCII_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL["op13_line_runs"] = f"""
WITH texts AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
lines AS (SELECT doc_id, unnest(parts) AS line, unnest(range(len(parts))) AS place FROM texts),
keyed AS (SELECT *, {ASCII_LOWER.format("trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS key FROM lines),
repeated AS (
  SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
judged AS (
  SELECT k.doc_id, k.place, k.line, r.key IS NOT NULL AND r.last <> k.doc_id AS lost
  FROM keyed k LEFT JOIN repeated r ON r.key = k.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (lost)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT lost), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""

SQL["op12_filter_audit"] = r"""
WITH texts AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
firsts AS (SELECT t, min(doc_id) AS least FROM texts GROUP BY t),
known AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
judged AS (
  SELECT x.part, coalesce(k.good, 0) AS good, coalesce(k.toxic, 0) AS toxic,
         [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * length(regexp_replace(x.t, '[^A-Z]', '', 'g')) > 2 * length(x.t),
          regexp_matches(x.t, '[#$%&*|]'), coalesce(x.doc_id > f.least, false)] AS fails
  FROM texts x JOIN firsts f ON f.t = x.t LEFT JOIN known k ON k.doc_id = x.doc_id),
counts AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM judged GROUP BY ALL),
letters AS (SELECT unnest([1, 2, 3, 4, 5]) AS v),
orders AS (
  SELECT [a.v, b.v, c.v, d.v, e.v] AS o FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.v, b.v, c.v, d.v, e.v])) = 5),
steps AS (SELECT o, unnest(range(1, 6))::INTEGER AS step FROM orders),
sums AS (
  SELECT part, o, step, any_value(o[step]) AS v,
         coalesce(sum(n) FILTER (len(list_filter(o[:step], lambda f: fails[f])) = 0), 0) AS kept,
         coalesce(sum(n) FILTER (fails[o[step]] AND len(list_filter(o[:step - 1], lambda f: fails[f])) = 0), 0) AS removed,
         coalesce(sum(n) FILTER (fails[o[step]] AND len(list_filter(o[:step - 1], lambda f: fails[f])) > 0), 0) AS redundant,
         coalesce(sum(n) FILTER (fails[o[step]] AND len(list_filter(fails, lambda f: f)) = 1), 0) AS unique_fails,
         coalesce(sum(good) FILTER (fails[o[step]] AND len(list_filter(o[:step - 1], lambda f: fails[f])) = 0), 0) AS good_lost,
         coalesce(sum(toxic) FILTER (fails[o[step]] AND len(list_filter(o[:step - 1], lambda f: fails[f])) = 0), 0) AS toxic_lost
  FROM counts, steps GROUP BY part, o, step)
SELECT part, array_to_string(list_transform(o, lambda v: 'ABCDE'[v]), '') AS filter_order, step, kept::BIGINT AS kept,
       removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost,
       toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, v))::BIGINT AS shapley
FROM sums
"""

SQL["op11_source_divergence"] = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all({ASCII_LOWER.format("coalesce(text, '')")}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
words AS (SELECT id, lang, source, unnest(w) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS n FROM words GROUP BY 1, 2 HAVING count(DISTINCT id) >= 30),
counts AS (SELECT lang, source, term, count(*) AS n FROM words JOIN kept USING (lang, term) GROUP BY 1, 2, 3),
groups AS (SELECT DISTINCT lang, source FROM docs),
sizes AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY 1),
totals AS (
  SELECT g.lang, g.source, coalesce(sum(c.n), 0) AS total FROM groups g LEFT JOIN counts c USING (lang, source) GROUP BY 1, 2),
shares AS (
  SELECT t.lang, t.source, k.term, coalesce(c.n, 0) AS n,
         1 + ((1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (t.total + 5 * s.v)) AS p,
         1 + ((1000000000::HUGEINT * (k.n + 5)) // (s.total + 5 * s.v)) AS q
  FROM totals t JOIN kept k USING (lang) JOIN sizes s USING (lang)
  LEFT JOIN counts c ON c.lang = t.lang AND c.source = t.source AND c.term = k.term),
sums AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM shares a JOIN shares b ON b.lang = a.lang AND b.term = a.term AND b.source <> a.source GROUP BY 1, 2, 3),
listed AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
  FROM groups a JOIN groups b ON b.lang = a.lang AND b.source <> a.source
  LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, p - q FROM shares WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS r FROM listed)
SELECT lang, source, part, item, value::BIGINT AS value, r::INTEGER AS rank FROM ranked WHERE part = 'pair' OR r <= 50
"""
