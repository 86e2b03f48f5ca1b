"""SQL for the queries that SQL can express, and the SQL of the pipeline."""

OP3_MIX_SOURCES = r"""
WITH d AS (
  SELECT doc_id, source, COALESCE(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(COALESCE(doc_id::VARCHAR, 'null') || ':' || md5(COALESCE(text, '')) || ':mix') AS turn
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source IS NULL, source) AS source_rank
  FROM d GROUP BY source
), w AS (
  SELECT *, CASE (source_rank - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM s
), f AS (
  SELECT *, (sum(source_size) OVER () - COALESCE(sum(3 * source_size) OVER upto, 0))::DOUBLE
            / (sum(weight) OVER () - COALESCE(sum(weight) OVER upto, 0)) AS raw_level,
         row_number() OVER (ORDER BY source_size / weight, source_rank) AS turn_of_fill
  FROM w
  WINDOW upto AS (ORDER BY source_size / weight, source_rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), o AS (
  SELECT *, (SELECT arg_min(g.raw_level, g.turn_of_fill) FROM f g
             WHERE 3 * g.source_size > g.raw_level * g.weight AND g.turn_of_fill <= f.turn_of_fill) AS fill
  FROM f
), t AS (
  SELECT source, source_size, source_rank, COALESCE(fill * weight, (3 * source_size)::DOUBLE) AS target FROM o
), q AS (
  SELECT d.*, t.source_size, t.source_rank, t.target, c.copy,
         CASE WHEN size > 0 THEN (c.copy * t.source_size + sum(size) OVER (
           PARTITION BY t.source_rank, c.copy ORDER BY turn, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))::DOUBLE
           / t.target ELSE 0 END AS finish
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source CROSS JOIN (VALUES (0), (1), (2)) c(copy)
), r AS (
  SELECT *, sum(size) OVER (ORDER BY finish, source_rank, copy, turn, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS running
  FROM q
)
SELECT doc_id, size, source_size, target,
       sum(CASE WHEN running <= (SELECT sum(size) FROM d) THEN size ELSE 0 END)::BIGINT AS taken
FROM r GROUP BY doc_id, size, source_size, target
"""

OP12_URL_RULES = r"""
WITH r(host, path, verdict) AS (
  VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
), u AS (
  SELECT page_id, row_number() OVER () AS n,
         CASE WHEN instr(url, '://') > 0 THEN substring(url, instr(url, '://') + 3) ELSE '' END AS rest
  FROM pages
), p AS (
  SELECT n, page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM u
), f AS (
  SELECT p.n, arg_max(r.host || r.path, length(r.host || r.path)) AS rule, arg_max(r.verdict, length(r.host || r.path)) AS verdict
  FROM p JOIN r ON ('.' || p.host) LIKE ('%.' || r.host) AND starts_with(p.path, r.path)
  GROUP BY p.n
)
SELECT page_id, host, path, rule, COALESCE(verdict, 'allow') AS verdict FROM p LEFT JOIN f USING (n)
"""

OP11_LEXICAL_SEARCH = r"""
WITH d AS (
  SELECT row_number() OVER () AS seat, doc_id,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents
), t AS (
  SELECT seat, doc_id, len(terms)::BIGINT AS n, unnest(terms) AS term FROM d
), c AS (
  SELECT count(*) FILTER (len(terms) > 0) AS docs, sum(len(terms))::BIGINT AS total FROM d
), i AS (
  SELECT row_number() OVER () AS q, item_id,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM benchmark
), qt AS (
  SELECT DISTINCT q, item_id, unnest(terms) AS term FROM i
), tf AS (
  SELECT seat, doc_id, n, term, count(*) AS tf FROM t WHERE term IN (SELECT term FROM qt) GROUP BY ALL
), w AS (
  SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w
  FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), c
), s AS (
  SELECT qt.q, qt.item_id, tf.seat, tf.doc_id,
         sum(w.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 8 * (10 + (90 * tf.n * c.docs) // c.total))))::BIGINT AS score
  FROM qt JOIN tf USING (term) JOIN w USING (term), c GROUP BY ALL
), r AS (
  SELECT item_id, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank, doc_id, score
  FROM s WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10
"""

ORACLE = {"op3_mix_sources": OP3_MIX_SOURCES, "op11_lexical_search": OP11_LEXICAL_SEARCH, "op12_url_rules": OP12_URL_RULES}
