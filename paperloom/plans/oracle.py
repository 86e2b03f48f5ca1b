"""SQL counterparts of the catalog queries, for DuckDB over the driver's tables."""

from __future__ import annotations

import re

from paperloom import taxonomy
from paperloom.plans.sample_tables import WORDED_CATEGORIES, WORDED_TITLES

_PAPERS = r"""
items AS (
  SELECT l_orderkey, min(p_brand) AS brand, min(p_type) AS main_type, list_sort(list(DISTINCT p_type)) AS types,
         list_sort(list_filter([min(p_name), max(p_name), max(CASE WHEN l_quantity > 25 THEN p_name END)],
                               lambda x: x IS NOT NULL)) AS names
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey
),
papers AS (
  SELECT o_orderkey AS paper_id,
    CASE WHEN o_orderkey % 97 = 0 THEN 'n/a' ELSE CAST(year(o_orderdate) + 3 AS VARCHAR) END AS publication_year,
    brand AS journal,
    CAST(CASE WHEN o_orderkey % 4 = 0 THEN 0 ELSE 1 END AS INTEGER) AS is_relevant,
    CASE WHEN brand IS NULL THEN NULL
         WHEN o_orderkey % 50 = 0 THEN 'Multi-Modal'
         WHEN o_orderkey % 50 = 1 THEN 'Knowledge Graph & Ontology'
         WHEN o_orderpriority = '1-URGENT' THEN 'Large Language Models (LLMs)'
         WHEN o_orderpriority = '2-HIGH' THEN 'Traditional Deep Learning'
         WHEN o_orderpriority = '3-MEDIUM' THEN 'Transformer-based (Non-LLM)'
         WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'Classical Machine Learning'
         WHEN o_orderpriority = '5-LOW' THEN 'Rule-Based & Hybrid' END AS method,
    CASE WHEN brand IS NULL THEN NULL WHEN o_orderkey % 3 = 0 THEN 'high'
         WHEN o_orderkey % 3 = 1 THEN 'medium' ELSE 'low' END AS method_confidence,
    names AS models,
    list_sort(list_transform(names, lambda x: split_part(x, ' ', 1))) AS tags,
    types AS materials,
    CASE WHEN brand IS NULL THEN NULL WHEN o_orderstatus = 'F' THEN 'high'
         WHEN o_orderstatus = 'O' THEN 'medium' ELSE 'low' END AS material_confidence,
    main_type AS material
  FROM orders LEFT JOIN items ON o_orderkey = l_orderkey
),
dated AS (
  SELECT * FROM (SELECT *, TRY_CAST(publication_year AS DOUBLE) AS year FROM papers)
  WHERE year BETWEEN 2000 AND 2026
)"""

_DOCUMENTS = r"""
docs AS (
  SELECT doc_id AS paper_id, CASE WHEN source <> 'src0' THEN split_part(text, chr(10), 1) END AS article_title,
         lang AS author_keywords, text AS abstract, source AS journal
  FROM documents
),
prompts AS (
  SELECT paper_id, 'Title: ' || coalesce(article_title, 'nan') || chr(10) || 'Keywords: '
    || coalesce(author_keywords, 'nan') || ' | N/A' || chr(10) || 'Abstract: ' || coalesce(abstract, 'nan') AS prompt
  FROM docs
),
searchable AS (
  SELECT *, concat_ws(' | ', article_title, abstract, author_keywords) AS body FROM docs
)"""

_FENCE = "repeat(chr(96), 3)"

_MATERIAL_REPLIES = (
    _PAPERS
    + rf"""
, bodies AS (
  SELECT *, to_json(materials)::VARCHAR AS listed,
    '{{"material_categories":' || to_json(materials)::VARCHAR || ',"confidence":"' || material_confidence
      || '","primary_category":"' || material || '"}}' AS body,
    '{{"material_categories":' || to_json(materials)::VARCHAR || '}}' AS only_first,
    '{{"material_categories":null,"confidence":"high"}}' AS null_list
  FROM papers WHERE material IS NOT NULL
)"""
)
_METHOD_REPLIES = (
    _PAPERS
    + rf"""
, bodies AS (
  SELECT *, to_json(models)::VARCHAR AS listed,
    '{{"primary_category":"' || method || '","specific_models":' || to_json(models)::VARCHAR || ',"secondary_tags":'
      || to_json(tags)::VARCHAR || ',"confidence":"' || method_confidence || '"}}' AS body,
    '{{"primary_category":"' || method || '"}}' AS only_first,
    '{{"specific_models":null,"confidence":"high"}}' AS null_list
  FROM papers WHERE method IS NOT NULL
)"""
)
_SHAPES = rf"""
, replies AS (
  SELECT paper_id, CASE paper_id % 11
    WHEN 0 THEN body
    WHEN 1 THEN {_FENCE} || 'json' || chr(10) || body || chr(10) || {_FENCE}
    WHEN 2 THEN {_FENCE} || chr(10) || body || chr(10) || {_FENCE}
    WHEN 3 THEN body || ' done'
    WHEN 4 THEN left(body, length(body) - 1)
    WHEN 5 THEN only_first
    WHEN 6 THEN listed
    WHEN 7 THEN null_list
    WHEN 8 THEN 'Here it is: ' || {_FENCE} || body || {_FENCE}
    WHEN 9 THEN chr(10) || chr(10) || '  ' || body || chr(10) || ' '
    ELSE body || body END AS reply
  FROM bodies
),
unfenced AS (
  SELECT paper_id, CASE WHEN starts_with(r, {_FENCE})
      THEN regexp_replace(split_part(r, {_FENCE}, 2), '^json', '') ELSE r END AS body
  FROM (SELECT paper_id, trim(reply, ' ' || chr(10)) AS r FROM replies)
),
parsed AS (
  SELECT paper_id, CASE WHEN json_valid(body) AND json_type(body) = 'OBJECT' THEN body END AS doc FROM unfenced
)"""


def _text(key: str, default: str) -> str:
    return (
        f"CASE WHEN doc IS NULL OR NOT json_exists(doc, '$.{key}') THEN '{default}' "
        f"ELSE json_extract_string(doc, '$.{key}') END"
    )


def _list(key: str, default: str) -> str:
    return (
        f"CASE WHEN doc IS NULL THEN '{default}' WHEN NOT json_exists(doc, '$.{key}') THEN '[]' "
        f"WHEN json_type(json_extract(doc, '$.{key}')) = 'ARRAY' THEN json_extract(doc, '$.{key}')::VARCHAR END"
    )


_MATERIAL_RECORD = f"""
  {_list("material_categories", '["Other Materials"]')} AS material_categories,
  {_text("confidence", "low")} AS material_confidence,
  {_text("primary_category", "Other Materials")} AS primary_material_category"""
_METHOD_RECORD = f"""
  {_text("primary_category", "Other/Unspecified")} AS model_primary_category,
  {_list("specific_models", "[]")} AS model_specific_models,
  {_list("secondary_tags", "[]")} AS model_secondary_tags,
  {_text("confidence", "low")} AS model_confidence"""

_LLM = "(contains({0}, 'LLM') OR contains({0}, 'Large Language'))"


def _llm(column: str) -> str:
    return f"coalesce({_LLM.format(column)}, false)"


def _papers(sql: str) -> str:
    return f"WITH {_PAPERS}\n{sql}"


def _docs(sql: str) -> str:
    return f"WITH {_DOCUMENTS}\n{sql}"


_MATERIAL_TABLE = """
mention AS (SELECT unnest(materials) AS item FROM papers WHERE material IS NOT NULL),
totals AS (SELECT count(*) AS n_papers, count(material) AS n_classified,
                  (SELECT count(*) FROM mention) AS n_mentions,
                  count(CASE WHEN material IS NOT NULL THEN materials END) AS n_readable FROM papers),
report AS (
  SELECT 'papers' AS section, '' AS item, n_papers AS n, NULL::DOUBLE AS pct, NULL::DOUBLE AS pct_mentions FROM totals
  UNION ALL SELECT 'classified', '', n_classified, n_classified / n_papers * 100, NULL FROM totals
  UNION ALL SELECT 'primary', material, count(*), count(*) / any_value(n_classified) * 100, NULL
    FROM papers, totals WHERE material IS NOT NULL GROUP BY material
  UNION ALL SELECT 'mention', item, count(*), count(*) / any_value(n_classified) * 100,
    count(*) / any_value(n_mentions) * 100 FROM mention, totals GROUP BY item
  UNION ALL SELECT 'confidence', material_confidence, count(*), count(*) / any_value(n_classified) * 100, NULL
    FROM papers, totals WHERE material IS NOT NULL GROUP BY material_confidence
  UNION ALL SELECT 'n_labels', CAST(len(materials) AS VARCHAR), count(*), count(*) / any_value(n_readable) * 100, NULL
    FROM papers, totals WHERE material IS NOT NULL GROUP BY len(materials)
  UNION ALL SELECT 'combination', array_to_string(materials, ' + '), count(*), NULL, NULL
    FROM papers WHERE material IS NOT NULL AND len(materials) > 1 GROUP BY materials HAVING count(*) >= 3
)"""

_METHOD_TABLE = """
WITH t AS (SELECT count(*) AS c, count(method) AS k FROM papers),
        m AS (SELECT unnest(models) AS item FROM papers WHERE method IS NOT NULL),
        g AS (SELECT unnest(tags) AS item FROM papers WHERE method IS NOT NULL)
        SELECT 'papers' AS section, '' AS item, c AS n, NULL::DOUBLE AS pct FROM t
        UNION ALL SELECT 'classified', '', k, k / c * 100 FROM t
        UNION ALL SELECT 'primary', method, count(*), count(*) / any_value(k) * 100 FROM papers, t
                  WHERE method IS NOT NULL GROUP BY method
        UNION ALL SELECT 'confidence', method_confidence, count(*), count(*) / any_value(k) * 100 FROM papers, t
                  WHERE method IS NOT NULL GROUP BY method_confidence
        UNION ALL SELECT 'model', item, n, NULL FROM (SELECT item, count(*) AS n FROM m GROUP BY item
                  ORDER BY n DESC, item LIMIT 20) WHERE n >= 3
        UNION ALL SELECT 'tag', item, count(*), count(*) / any_value(k) * 100 FROM g, t GROUP BY item"""

_HITS = r"""
tokens AS (
  SELECT *, regexp_extract_all(body, '[\p{L}\p{N}_]+') AS words FROM searchable
),
hits AS (
  SELECT paper_id, article_title,
    len(list_filter(words, lambda w: starts_with(lower(w), 'license') OR starts_with(lower(w), 'under'))) AS h1,
    len(regexp_extract_all(body, '(?i)(^|[^\p{L}\p{N}_])rights\s+reserved')) AS h2,
    len(list_filter(words, lambda w: starts_with(lower(w), 'the') OR starts_with(lower(w), 'and'))) AS h3,
    len(list_filter(words, lambda w: starts_with(lower(w), 'pour') OR starts_with(lower(w), 'dans'))) AS h4,
    len(list_filter(words, lambda w: w IN ('Apache', 'Apaches'))) AS h5,
    coalesce(regexp_matches(article_title,
      '(^|[^\p{L}\p{N}_])(?:(?i:license|under|rights\s+reserved|the|and|pour|dans)|Apaches?([^\p{L}\p{N}_]|$))'), false) AS in_title
  FROM tokens
)"""


def _group(terms: str) -> str:
    return rf"regexp_matches(body, '(?i)(^|[^\p{{L}}\p{{N}}_])(?:{terms})([^\p{{L}}\p{{N}}_]|$)')"


_ANY = r"[\p{L}\p{N}_]*"
_W = r"[\p{L}\p{N}_]"
_NOT_W = r"[^\p{L}\p{N}_]"


def _topic(terms: list[str]) -> str:
    """Whether one of the real search terms stands in the body."""
    return _group("|".join(re.sub(r"\s+", r"[[:space:]]+", t.removesuffix("*")) + (_ANY if t.endswith("*") else "") for t in terms))


def _words(words: list[str], text: str) -> str:
    """How often words of a real list stand in a text whose other characters are all doubled, so that each of
    two words beside each other has a border of its own."""
    parts = []
    for word in words:
        plain = word == word.lower()
        stem = word[:-1] if re.search(r"[^sui]s$", word) else word
        stem = "[[:space:]]+".join(re.sub(r"([^A-Za-z0-9])", r"[\1][\1]", w) for w in stem.split())
        parts.append(f"(?i:{stem}){_W}*" if plain else f"{stem}s?(?:{_NOT_W}|$)")
    return f"len(regexp_extract_all({text}, '(?:^|{_NOT_W})(?:{'|'.join(parts)})'))"


def _lexicon(lexicon: dict[str, list[str]], fallback: str, labels: str, primary: str, confidence: str) -> str:
    """Labels by the real word lists."""
    names = list(lexicon)
    quoted = "[" + ", ".join(f"'{n}'" for n in names) + "]"
    counts = "[" + ", ".join(_words(lexicon[n], "doubled") for n in names) + "]"
    everything = [w for words in lexicon.values() for w in words]
    return f"""
  SELECT *, CASE WHEN n = 0 THEN '["{fallback}"]' ELSE to_json(list_filter({quoted}, lambda x, i: h[i] > 0))::VARCHAR END AS {labels},
    CASE WHEN n = 0 THEN '{fallback}' ELSE {quoted}[list_position(h, list_max(h))] END AS {primary},
    CASE WHEN n = 0 THEN 'low' WHEN titled > 0 THEN 'high' ELSE 'medium' END AS {confidence}
  FROM (SELECT *, list_sum(h) AS n FROM (
    SELECT *, {counts} AS h, {_words(everything, "doubled_title")} AS titled FROM doubled))"""


_TITLES = "[" + ", ".join(f"'{t}'" for t in WORDED_TITLES) + "]"
_CATEGORIES = "[" + ", ".join("NULL" if c is None else f"'{c}'" for c in WORDED_CATEGORIES) + "]"
_WORDED = rf""",
worded AS (
  SELECT paper_id, {_TITLES}[paper_id % {len(WORDED_TITLES)} + 1] AS article_title, abstract,
         {_CATEGORIES}[paper_id % {len(WORDED_CATEGORIES)} + 1] AS wos_category
  FROM docs
),
bodies AS (SELECT *, concat_ws(' | ', article_title, abstract) AS body FROM worded),
doubled AS (
  SELECT *, regexp_replace(body, '({_NOT_W})', '\1\1', 'g') AS doubled, regexp_replace(article_title, '({_NOT_W})', '\1\1', 'g') AS doubled_title
  FROM bodies
)"""
_NAMES = sorted([w for words in taxonomy.METHOD_WORDS.values() for w in words if w != w.lower()], key=len, reverse=True)
_RELEVANCE = "CAST(CASE WHEN contains(prompt, 'license') THEN 1 ELSE 0 END AS INTEGER)"
_SCORED = f"""
SELECT paper_id, coalesce(l.quality, {_RELEVANCE})::INTEGER AS is_relevant
FROM prompts LEFT JOIN labels l ON l.doc_id = paper_id"""

_SUMMARY_TABLE = f""", t AS (SELECT count(*) AS c, min(year) AS y0, max(year) AS y1,
                    count(*) FILTER (WHERE {_llm("method")}) AS llm FROM dated),
report AS (
        SELECT 'basic' AS section, 'papers' AS item, c::DOUBLE AS n, NULL::DOUBLE AS pct FROM t
        UNION ALL SELECT 'basic', 'first_year', y0, NULL FROM t
        UNION ALL SELECT 'basic', 'last_year', y1, NULL FROM t
        UNION ALL SELECT 'basic', 'papers_per_year', c / (y1 - y0 + 1), NULL FROM t
        UNION ALL SELECT 'recent', 'last_years', count(*), count(*) / any_value(c) * 100 FROM dated, t WHERE year >= y1 - 4
        UNION ALL SELECT 'year', CAST(year AS VARCHAR), count(*), NULL FROM dated, t WHERE year >= y1 - 4 GROUP BY year
        UNION ALL SELECT 'llm_papers', '', llm, llm / c * 100 FROM t
        UNION ALL (SELECT 'method', method, count(*), count(*) / any_value(c) * 100 FROM dated, t
                   WHERE method IS NOT NULL GROUP BY method ORDER BY count(*) DESC, method LIMIT 10)
        UNION ALL (SELECT 'material', material, count(*), count(*) / any_value(c) * 100 FROM dated, t
                   WHERE material IS NOT NULL GROUP BY material ORDER BY count(*) DESC, material LIMIT 10)
        UNION ALL SELECT 'method_confidence', method_confidence, count(*), count(*) / any_value(c) * 100 FROM dated, t
                  WHERE method_confidence IS NOT NULL GROUP BY method_confidence
        UNION ALL SELECT 'material_confidence', material_confidence, count(*), count(*) / any_value(c) * 100 FROM dated, t
                  WHERE material_confidence IS NOT NULL GROUP BY material_confidence
)"""

SQL: dict[str, str] = {
    "csv_na_normalise": _papers(
        "SELECT paper_id, CASE WHEN publication_year <> 'n/a' THEN publication_year END AS publication_year, journal FROM papers"
    ),
    "csv_round_trip": f"""WITH {_PAPERS}, {_DOCUMENTS}
        SELECT d.paper_id, article_title, author_keywords, abstract, d.journal,
               CASE WHEN publication_year <> 'n/a' THEN publication_year END AS publication_year
        FROM docs d LEFT JOIN papers p ON d.paper_id = p.paper_id""",
    "column_resolution": _papers(
        "SELECT paper_id, journal, publication_year, TRY_CAST(publication_year AS DOUBLE) AS year, is_relevant FROM papers"
    ),
    "year_parse_filter": _papers("SELECT paper_id, year FROM dated"),
    "relevant_papers": _papers(
        "SELECT paper_id, method AS model_primary_category FROM papers WHERE is_relevant = 1 AND method IS NOT NULL"
    ),
    "category_members": _papers(
        "SELECT paper_id, material AS primary_material_category FROM papers WHERE list_contains(materials, 'PROMO')"
    ),
    "export_by_category": _papers(
        """, rows AS (SELECT DISTINCT paper_id, journal, unnest(materials) AS category FROM papers)
        SELECT translate(category, '/ ', '-_') AS category_file, paper_id, journal FROM rows"""
    ),
    "papers_per_category": _papers(
        """, rows AS (SELECT paper_id, unnest(materials) AS category FROM papers)
        SELECT category, count(DISTINCT paper_id) AS n, 'category_file=' || translate(category, '/ ', '-_') AS filename
        FROM rows GROUP BY category"""
    ),
    "exported_total": _papers(
        """, rows AS (SELECT unnest(materials) AS category FROM papers)
        SELECT count(*) AS n_rows, count(DISTINCT category) AS n_files FROM rows"""
    ),
    "coverage": _papers(
        "SELECT count(*) AS n_papers, count(method) AS n_classified, count(method) / count(*) * 100 AS pct_classified FROM papers"
    ),
    "relevance_stats": _papers(
        """SELECT p.is_relevant, count(*) AS n, any_value(s) AS n_relevant, any_value(c) AS n_papers,
               any_value(s) / any_value(c) * 100 AS pct_relevant
        FROM papers p, (SELECT CAST(sum(is_relevant) AS BIGINT) AS s, count(*) AS c FROM papers) GROUP BY p.is_relevant"""
    ),
    "method_distribution": _papers(
        """SELECT method AS key, count(*) AS n, count(*) / (SELECT count(method) FROM papers) * 100 AS pct
        FROM papers WHERE method IS NOT NULL GROUP BY method"""
    ),
    "material_distribution": _papers(
        """SELECT material AS key, count(*) AS n, count(*) / (SELECT count(material) FROM papers) * 100 AS pct
        FROM papers WHERE material IS NOT NULL GROUP BY material"""
    ),
    "method_share_nonnull": _papers(
        """SELECT *, contains(key, 'Large Language') AS highlight, pct >= 4.0 OR contains(key, 'Large Language') AS show_label
        FROM (SELECT method AS key, count(*) AS n, count(*) / (SELECT count(method) FROM papers) * 100 AS pct
              FROM papers WHERE method IS NOT NULL GROUP BY method)"""
    ),
    "method_share_all": _papers(
        """SELECT method AS key, count(*) AS n, count(*) / (SELECT count(*) FROM papers) * 100 AS pct
        FROM papers WHERE method IS NOT NULL GROUP BY method"""
    ),
    "confidence_of_classified": _papers(
        """SELECT method_confidence AS key, count(*) AS n, count(*) / (SELECT count(method) FROM papers) * 100 AS pct
        FROM papers WHERE method IS NOT NULL GROUP BY method_confidence"""
    ),
    "confidence_distribution": _papers(
        """SELECT 'model_confidence' AS dimension, method_confidence AS key, count(*) AS n,
               count(*) / (SELECT count(method_confidence) FROM papers) * 100 AS pct
        FROM papers WHERE method_confidence IS NOT NULL GROUP BY method_confidence
        UNION ALL
        SELECT 'material_confidence', material_confidence, count(*),
               count(*) / (SELECT count(material_confidence) FROM papers) * 100
        FROM papers WHERE material_confidence IS NOT NULL GROUP BY material_confidence"""
    ),
    "top_specific_models": _papers(
        """, m AS (SELECT unnest(models) AS key FROM papers WHERE method IS NOT NULL)
        SELECT * FROM (SELECT key, count(*) AS n FROM m GROUP BY key ORDER BY n DESC, key LIMIT 20) WHERE n >= 3"""
    ),
    "tag_distribution": _papers(
        """, m AS (SELECT unnest(tags) AS key FROM papers WHERE method IS NOT NULL)
        SELECT key, count(*) AS n, count(*) / (SELECT count(method) FROM papers) * 100 AS pct_papers FROM m GROUP BY key"""
    ),
    "category_mentions": _papers(
        """, m AS (SELECT unnest(materials) AS key FROM papers WHERE material IS NOT NULL)
        SELECT key, count(*) AS n, count(*) / (SELECT count(material) FROM papers) * 100 AS pct_papers,
               count(*) / (SELECT count(*) FROM m) * 100 AS pct_mentions FROM m GROUP BY key"""
    ),
    "labels_per_paper": _papers(
        """SELECT CAST(len(materials) AS INTEGER) AS n_labels, count(*) AS n,
               count(*) / (SELECT count(materials) FROM papers) * 100 AS pct
        FROM papers WHERE materials IS NOT NULL GROUP BY len(materials)"""
    ),
    "multi_label_papers": _papers(
        "SELECT paper_id, material AS primary_material_category FROM papers WHERE len(materials) > 1"
    ),
    "label_combinations": _papers(
        """SELECT array_to_string(materials, ' + ') AS combination, count(*) AS n
        FROM papers WHERE len(materials) > 1 GROUP BY materials HAVING count(*) >= 3"""
    ),
    "distinct_labels": _papers("SELECT DISTINCT unnest(materials) AS label FROM papers"),
    "others_collapse": _papers(
        f""", c AS (SELECT method AS key, count(*) AS n FROM papers WHERE method IS NOT NULL GROUP BY method),
        t AS (SELECT CAST(sum(n) AS BIGINT) AS total FROM c),
        g AS (SELECT CASE WHEN n / total >= 0.03 OR regexp_matches(key, '(?i)Large Language') THEN key ELSE 'Others' END AS key,
                     CAST(sum(n) AS BIGINT) AS n, any_value(total) AS total FROM c, t GROUP BY 1)
        SELECT key, n, n / total * 100 AS pct, {_llm("key")} AS highlight,
               n / total >= 0.04 OR {_llm("key")} AS show_label FROM g"""
    ),
    "top_journals": _papers(
        """SELECT journal AS key, count(*) AS n FROM papers WHERE journal IS NOT NULL
        GROUP BY journal ORDER BY n DESC, journal LIMIT 15"""
    ),
    "top_materials": _papers(
        """SELECT material AS key, count(*) AS n FROM papers WHERE material IS NOT NULL
        GROUP BY material ORDER BY n DESC, material LIMIT 12"""
    ),
    "method_material_crosstab": _papers(
        """, r AS (SELECT method AS row, count(*) AS row_total FROM papers WHERE method IS NOT NULL
                GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8),
        c AS (SELECT material AS col, count(*) AS col_total FROM papers WHERE material IS NOT NULL
              GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10)
        SELECT r.row, c.col, count(p.paper_id) AS n, r.row_total, c.col_total
        FROM r CROSS JOIN c LEFT JOIN papers p ON p.method = r.row AND p.material = c.col
        GROUP BY r.row, c.col, r.row_total, c.col_total"""
    ),
    "llm_total": _papers(
        f"""SELECT count(*) FILTER (WHERE {_llm("method")}) AS n, count(*) AS n_papers,
               count(*) FILTER (WHERE {_llm("method")}) / count(*) * 100 AS pct FROM papers"""
    ),
    "basic_stats": _papers(
        """SELECT count(*) AS n_papers, min(year) AS first_year, max(year) AS last_year,
               count(*) / (max(year) - min(year) + 1) AS papers_per_year FROM dated"""
    ),
    "yearly_counts": _papers("SELECT year, count(*) AS n FROM dated GROUP BY year"),
    "yearly_growth": _papers(
        """, c AS (SELECT year, count(*) AS n FROM dated GROUP BY year)
        SELECT year, n, (n / lag(n) OVER (ORDER BY year) - 1) * 100 AS growth_pct FROM c"""
    ),
    "journal_growth": _papers(
        """, c AS (SELECT journal, year, count(*) AS n FROM dated WHERE journal IS NOT NULL GROUP BY journal, year)
        SELECT journal, year, n, (n / lag(n) OVER (PARTITION BY journal ORDER BY year) - 1) * 100 AS growth_pct FROM c"""
    ),
    "recent_share": _papers(
        """SELECT count(*) FILTER (WHERE year >= m - 2) AS n_recent, count(*) AS n_papers,
               count(*) FILTER (WHERE year >= m - 2) / count(*) * 100 AS pct_recent
        FROM dated, (SELECT max(year) AS m FROM dated)"""
    ),
    "recent_years": _papers(
        "SELECT year, count(*) AS n FROM dated WHERE year >= (SELECT max(year) FROM dated) - 2 GROUP BY year"
    ),
    "llm_by_year": _papers(
        f"""SELECT year, count(*) FILTER (WHERE {_llm("method")}) AS llm,
               count(*) FILTER (WHERE NOT {_llm("method")}) AS non_llm FROM dated GROUP BY year"""
    ),
    "llm_share_by_year": _papers(
        f""", c AS (SELECT year, count(*) FILTER (WHERE {_llm("method")}) AS llm,
                   count(*) FILTER (WHERE NOT {_llm("method")}) AS non_llm FROM dated GROUP BY year)
        SELECT year, llm, non_llm, llm + non_llm AS n, llm / (llm + non_llm) * 100 AS llm_pct,
               llm / 2 AS llm_mid_area, non_llm / 2 AS non_llm_mid, non_llm + llm / 2 AS llm_mid_bar,
               llm / (llm + non_llm) * 100 > 0 AS label_area, llm / (llm + non_llm) * 100 > 2 AS label_bar FROM c"""
    ),
    "llm_flags": _papers(
        f"""SELECT paper_id, CASE WHEN {_llm("method")} THEN 'LLM' ELSE 'Non-LLM' END AS is_llm,
               CASE WHEN contains(method, 'Large Language') THEN 'LLM' ELSE 'Non-LLM' END AS is_llm_strict FROM papers"""
    ),
    # Every journal has papers in five consecutive years; for five evenly spaced points the curve has
    # this closed form in the second differences.
    "trend_curve": _papers(
        """, c AS (SELECT journal AS series, year, count(*) AS n FROM dated WHERE journal IS NOT NULL GROUP BY ALL),
        w AS (SELECT series, min(year) AS y0, list(n::DOUBLE ORDER BY year) AS v FROM c GROUP BY series),
        d AS (SELECT *, v[1] - 2 * v[2] + v[3] AS b1, v[2] - 2 * v[3] + v[4] AS c2, v[3] - 2 * v[4] + v[5] AS b3 FROM w),
        b AS (SELECT *, (6 * c2 - b1 - b3) / 4 AS b2 FROM d),
        m AS (SELECT series, y0, v, [2 * b1 - b2, b1, b2, b3, 2 * b3 - b2] AS bend FROM b),
        g AS (SELECT m.*, range * 4::DOUBLE / 299 AS s FROM m, range(300)),
        p AS (SELECT *, CAST(least(floor(s), 3) AS INTEGER) AS j FROM g),
        q AS (SELECT *, s - j AS l, 1 - (s - j) AS r FROM p)
        SELECT series, round(y0 + s, 6) AS x, round(greatest(
            (bend[j + 1] * r * r * r + bend[j + 2] * l * l * l) / 6
            + (v[j + 1] - bend[j + 1] / 6) * r + (v[j + 2] - bend[j + 2] / 6) * l, 0), 6) AS y FROM q"""
    ),
    "summary_report": _papers(f"{_SUMMARY_TABLE} SELECT * FROM report"),
    "material_report": _papers(f", {_MATERIAL_TABLE} SELECT * FROM report"),
    "method_report": _papers(
        f" SELECT * FROM ({_METHOD_TABLE})"
    ),
    "material_report_text": _papers(
        f""", {_MATERIAL_TABLE}
        , lines AS (SELECT CASE section WHEN 'primary' THEN 2 WHEN 'mention' THEN 3 WHEN 'confidence' THEN 4 WHEN 'n_labels' THEN 5
            WHEN 'combination' THEN 6 ELSE 1 END AS number, CASE section WHEN 'n_labels' THEN CAST(item AS DOUBLE) ELSE -n END AS rank, item,
          CASE section
          WHEN 'papers' THEN printf('Total papers in dataset: %d', n)
          WHEN 'classified' THEN printf('Papers with material classification: %d', n) || chr(10) || printf('Classification rate: %.1f%%', pct)
          WHEN 'primary' THEN printf('%-35s %4d (%5.1f%%) ', item, n, pct) || repeat('█', CAST(floor(pct / 2) AS INTEGER))
          WHEN 'mention' THEN printf('%-35s %4d (%5.1f%% of papers, %5.1f%% of mentions) ', item, n, pct, pct_mentions)
                              || repeat('█', CAST(floor(pct / 2) AS INTEGER))
          WHEN 'confidence' THEN printf('%-35s %4d (%5.1f%%)', item, n, pct)
          WHEN 'n_labels' THEN '  ' || item || CASE WHEN item = '1' THEN ' category' ELSE ' categories' END
                              || printf(': %4d papers (%5.1f%%)', n, pct)
          ELSE printf('%-60s %4d', item, n) END AS line
        FROM report
        UNION ALL SELECT i, '-infinity'::DOUBLE, '', ['MATERIAL CLASSIFICATION ANALYSIS REPORT', 'PRIMARY MATERIAL CATEGORY DISTRIBUTION',
          'ALL MATERIAL CATEGORIES (papers can have multiple)', 'CONFIDENCE DISTRIBUTION',
          'MULTI-CATEGORY ANALYSIS' || chr(10) || 'Number of material categories per paper:',
          'COMMON CATEGORY COMBINATIONS (appearing 3+ times)'][i] FROM range(1, 7) r(i))
        SELECT row_number() OVER (ORDER BY number, rank, item) AS line_no, line FROM lines"""
    ),
    "method_report_text": _papers(
        f""", report AS ({_METHOD_TABLE}), lines AS (
          SELECT CASE section WHEN 'primary' THEN 2 WHEN 'confidence' THEN 3 WHEN 'model' THEN 4 WHEN 'tag' THEN 5 ELSE 1 END AS number,
            -n::DOUBLE AS rank, item,
            CASE section
            WHEN 'papers' THEN printf('Total papers analyzed: %d', n)
            WHEN 'classified' THEN printf('Papers with model classification: %d', n) || chr(10) || printf('Classification rate: %.1f%%', pct)
            WHEN 'model' THEN rpad(item, 50, '.') || printf(' %4d', n)
            ELSE rpad(item, 50, '.') || printf(' %4d (%5.1f%%)', n, pct) END AS line
          FROM report
          UNION ALL SELECT i, '-infinity'::DOUBLE, '', ['MODEL CLASSIFICATION ANALYSIS', 'PRIMARY CATEGORY DISTRIBUTION',
            'CONFIDENCE DISTRIBUTION', 'TOP SPECIFIC MODELS (mentioned at least 3 times)', 'SECONDARY TAG DISTRIBUTION'][i] FROM range(1, 6) r(i))
        SELECT row_number() OVER (ORDER BY number, rank, item) AS line_no, line FROM lines"""
    ),
    "summary_report_text": _papers(
        f"""{_SUMMARY_TABLE},
        lines AS (
          SELECT list_position(['basic', 'recent', 'year', 'method', 'llm_papers', 'material', 'method_confidence', 'material_confidence'], section) AS number,
            CASE WHEN section = 'basic' THEN list_position(['papers', 'first_year', 'papers_per_year'], item)::DOUBLE
                 WHEN section = 'year' THEN -item::DOUBLE ELSE -n END AS rank, item,
            CASE WHEN item = 'papers' AND section = 'basic' THEN printf('Total Papers: %d', n::BIGINT)
                 WHEN item = 'first_year' THEN printf('Year Range: %d - %d', n::BIGINT, (SELECT n::BIGINT FROM report WHERE item = 'last_year'))
                 WHEN item = 'papers_per_year' THEN printf('Average Papers per Year: %.1f', n)
                 WHEN section = 'recent' THEN printf('Papers (Last 5 Years): %d (%.1f%%)', n::BIGINT, pct)
                 WHEN section = 'year' THEN printf('  %d: %d papers', item::DOUBLE::BIGINT, n::BIGINT)
                 WHEN section = 'llm_papers' THEN printf('  Total LLM Papers: %d (%.1f%%)', n::BIGINT, pct)
                 WHEN section IN ('method', 'material') THEN printf('  %-50s %4d (%5.1f%%)', item, n::BIGINT, pct)
                 ELSE printf('  %s: %d (%.1f%%)', item, n::BIGINT, pct) END AS line
          FROM report WHERE item <> 'last_year'
          UNION ALL SELECT [0, 1, 2, 4, 6, 7, 8][i], '-infinity'::DOUBLE, '', ['MATERIALS DATA EXTRACTION LITERATURE ANALYSIS SUMMARY', '1. BASIC STATISTICS',
            '2. RECENT GROWTH (Last 5 Years)', '3. MODEL CATEGORY DISTRIBUTION', '4. MATERIAL CATEGORY DISTRIBUTION',
            '5. CLASSIFICATION CONFIDENCE' || chr(10) || 'Model Classification:', 'Material Classification:'][i] FROM range(1, 8) r(i))
        SELECT row_number() OVER (ORDER BY number, rank, item) AS line_no, line FROM lines"""
    ),
    "parse_replies": f"WITH {_MATERIAL_REPLIES}{_SHAPES} SELECT paper_id, {_MATERIAL_RECORD} FROM parsed",
    "parse_method_replies": f"WITH {_METHOD_REPLIES}{_SHAPES} SELECT paper_id, {_METHOD_RECORD} FROM parsed",
    "parse_chat_turns": f"""WITH turns AS (SELECT conv_id, turn,
          CASE WHEN json_valid(text) AND json_type(text) = 'OBJECT' THEN text END AS doc
        FROM conversations)
        SELECT conv_id, turn, {_MATERIAL_RECORD} FROM turns""",
    "binary_decision": r"""SELECT event_id, number, CAST(CASE WHEN number = 1 THEN 1 ELSE 0 END AS INTEGER) AS decision
        FROM (SELECT event_id, CAST(regexp_extract(props, '(\d+)', 1) AS INTEGER) AS number FROM events)""",
    "llm_share_from_replies": f"""WITH {_METHOD_REPLIES}{_SHAPES},
        scored AS (SELECT paper_id, {_METHOD_RECORD} FROM parsed),
        c AS (SELECT year, count(*) FILTER (WHERE {_llm("model_primary_category")}) AS llm,
                     count(*) FILTER (WHERE NOT {_llm("model_primary_category")}) AS non_llm
              FROM dated LEFT JOIN scored USING (paper_id) GROUP BY year)
        SELECT year, llm, non_llm, llm / (llm + non_llm) * 100 AS llm_pct FROM c""",
    "scatter_results": f"""WITH {_MATERIAL_REPLIES}{_SHAPES},
        scored AS (SELECT paper_id, {_MATERIAL_RECORD} FROM parsed)
        SELECT p.paper_id, p.is_relevant, s.material_categories, s.material_confidence, s.primary_material_category
        FROM papers p LEFT JOIN scored s ON p.paper_id = s.paper_id""",
    "resume_pending": _docs(
        "SELECT paper_id, journal FROM docs WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = paper_id)"
    ),
    "resume_merge": _docs(
        "SELECT paper_id, CAST(quality AS INTEGER) AS is_relevant FROM docs LEFT JOIN labels ON doc_id = paper_id"
    ),
    "topic_filter": _docs(
        f"""SELECT paper_id, journal FROM searchable
        WHERE {_group("the|de" + _ANY + "|und")} AND {_group("with|pour|para|licens" + _ANY)}
          AND {_group("on" + _ANY + "|la")} AND NOT {_group("rights[[:space:]]+reserved|token")}"""
    ),
    "lexicon_tags": _docs(
        f""", {_HITS},
        lists AS (
          SELECT paper_id, in_title, [h1, h2, h3, h4, h5] AS h,
            list_filter([CASE WHEN h1 > 0 THEN 'Licences' END, CASE WHEN h2 > 0 THEN 'Rights' END,
                         CASE WHEN h3 > 0 THEN 'English' END, CASE WHEN h4 > 0 THEN 'French' END,
                         CASE WHEN h5 > 0 THEN 'Names' END], lambda x: x IS NOT NULL) AS labels
          FROM hits)
        SELECT paper_id, CASE WHEN len(labels) = 0 THEN '["None"]' ELSE to_json(labels)::VARCHAR END AS labels,
          CASE WHEN len(labels) = 0 THEN 'None'
               ELSE ['Licences', 'Rights', 'English', 'French', 'Names'][list_position(h, list_max(h))] END AS primary_label,
          CASE WHEN len(labels) = 0 THEN 'low' WHEN in_title THEN 'high' ELSE 'medium' END AS confidence
        FROM lists"""
    ),
    "topic_filter_default": _docs(
        f"""{_WORDED}
        SELECT paper_id, article_title FROM bodies
        WHERE {" AND ".join(_topic(terms) for terms in taxonomy.TOPIC_ALL_OF)} AND NOT {_topic(taxonomy.TOPIC_NONE_OF[0])}
          AND NOT coalesce(list_contains(list_transform(string_split(wos_category, ';'), lambda c: lower(trim(c))),
                                         '{taxonomy.TOPIC_EXCLUDED_CATEGORIES[0].lower()}'), false)"""
    ),
    "material_words": _docs(
        f"""{_WORDED}
        SELECT paper_id, material_categories, primary_material_category, material_confidence
        FROM ({_lexicon(taxonomy.MATERIAL_WORDS, taxonomy.MATERIAL_FALLBACK, "material_categories", "primary_material_category", "material_confidence")})"""
    ),
    "method_words": _docs(
        f"""{_WORDED}
        SELECT paper_id, model_primary_category, model_confidence,
          '[' || array_to_string(list_transform(list_filter(list_transform(regexp_extract_all(doubled,
              '(?:^|{_NOT_W})({"|".join(re.sub(r"([^A-Za-z0-9])", r"[\1][\1]", n) for n in _NAMES)})s?(?:{_NOT_W}|$)', 1),
              lambda x: regexp_replace(x, '({_NOT_W}){_NOT_W}', '\\1', 'g')),
            lambda x, i: list_position(list_transform(regexp_extract_all(doubled,
              '(?:^|{_NOT_W})({"|".join(re.sub(r"([^A-Za-z0-9])", r"[\1][\1]", n) for n in _NAMES)})s?(?:{_NOT_W}|$)', 1),
              lambda y: regexp_replace(y, '({_NOT_W}){_NOT_W}', '\\1', 'g')), x) = i),
            lambda x: '"' || x || '"'), ',') || ']' AS model_specific_models,
          to_json(list_filter({taxonomy.METHOD_TAGS}, lambda t: contains(lower(body), t)))::VARCHAR AS model_secondary_tags
        FROM ({_lexicon(taxonomy.METHOD_WORDS, taxonomy.METHOD_FALLBACK, "labels", "model_primary_category", "model_confidence")})"""
    ),
    "classify_methods": _docs(
        f"""{_WORDED}
        SELECT paper_id, CASE WHEN contains(body, 'GPT') OR contains(body, 'BERT') THEN 'Large Language Models (LLMs)' ELSE 'Rule-Based & Hybrid' END
            AS model_primary_category,
          CASE WHEN contains(body, 'GPT') THEN '["GPT-4"]' ELSE '[]' END AS model_specific_models, 'medium' AS model_confidence
        FROM bodies"""
    ),
    "render_prompt": _docs(
        "SELECT paper_id, prompt || chr(10) || chr(10) || 'Answer with one digit.' AS prompt FROM prompts"
    ),
    "score_batch": _docs(
        """, s AS (SELECT paper_id, length(prompt) AS len, contains(prompt, 'Apache') AS refused,
              CASE WHEN contains(prompt, 'license') THEN 'Polymers' ELSE 'Nanoparticles' END AS label FROM prompts)
        SELECT paper_id, CASE WHEN NOT refused THEN len END AS tokens,
          CASE WHEN refused THEN 'ValueError: refused' END AS error,
          CASE WHEN refused THEN '["Other Materials"]' ELSE '["' || label || '"]' END AS material_categories,
          CASE WHEN refused THEN 'low' ELSE 'high' END AS material_confidence,
          CASE WHEN refused THEN 'Other Materials' ELSE label END AS primary_material_category FROM s"""
    ),
    "scoring_usage": _docs(
        """SELECT count(*) AS n_papers, count(*) FILTER (WHERE contains(prompt, 'Apache')) AS n_errors,
          CAST(sum(length(prompt)) FILTER (WHERE NOT contains(prompt, 'Apache')) AS BIGINT) AS tokens FROM prompts"""
    ),
    "classify_batch": _docs(
        """SELECT paper_id, CAST(quality AS INTEGER) AS is_relevant,
          CASE WHEN quality = 1 THEN CASE WHEN contains(prompt, 'Apache') THEN 'Other Materials'
               WHEN contains(prompt, 'license') THEN 'Polymers' ELSE 'Nanoparticles' END END AS primary_material_category,
          CASE WHEN quality = 1 THEN CASE WHEN contains(prompt, 'Apache') THEN 'low' ELSE 'high' END END AS material_confidence
        FROM prompts LEFT JOIN labels ON doc_id = paper_id"""
    ),
    "resumable_scoring": _docs(_SCORED),
    "incremental_scoring": _docs(_SCORED),
}
