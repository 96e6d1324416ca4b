"""Registered queries and the SQL each one must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a (spark, sf_dir) -> DataFrame function under ``name``."""

    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


# ---- shared SQL fragments -------------------------------------------------------

TAGS = r"""list_transform(list_slice(list_sort(list_transform(
  list_distinct(regexp_extract_all(lower(text), '\p{L}{4,20}')), lambda t: {'l': -length(t), 't': t})), 1, 5), lambda s: s.t)"""

NOTES = f"""notes AS (
  SELECT doc_id, 'd' || doc_id AS note_name, lang || '/' || source AS category, {TAGS} AS tags,
         text AS summary, lang || '/' || source || '/d' || doc_id || '.md' AS rel_path, n_chars
  FROM documents)"""

PAGES = """pages0 AS (
  SELECT doc_id, 'd' || doc_id AS note_name, lang || '/' || source || '/d' || doc_id AS path,
         lang || '/' || source AS category,
         CASE WHEN n_chars >= 300 THEN text || chr(10) || chr(10) || chr(10)
              || ' [[d' || ((doc_id * 7 + 1) % (n * 6 // 5)) || ']] [[d' || ((doc_id * 13 + 5) % n) || '|see]]'
              ELSE text END AS content
  FROM documents, (SELECT count(*) AS n FROM documents)),
links AS (
  SELECT src, pos, t AS target_raw, replace(trim(t), ' ', '_') AS target FROM (
    SELECT note_name AS src, unnest(l) AS t, generate_subscripts(l, 1) - 1 AS pos FROM (
      SELECT note_name, regexp_extract_all(content, '\\[\\[([^\\]|]+?)(?:\\|[^\\]]+?)?\\]\\]', 1) AS l FROM pages0)))"""

MARKDOWN = NOTES + """,
md AS (
  SELECT doc_id, note_name, category, tags, rel_path,
    '---' || chr(10) || 'source: ' || note_name || '.md' || chr(10) || 'category: ' || category || chr(10)
    || 'tags: [' || array_to_string(tags, ', ') || ']' || chr(10) || '---' || chr(10)
    || '# ' || note_name || chr(10)
    || array_to_string(list_transform(string_split(summary, chr(10)),
         lambda s, i: CASE WHEN i % 3 = 0 THEN '## ' || s ELSE s END), chr(10)) AS content
  FROM notes)"""

CALLS = """calls AS (
  SELECT user_id AS provider, ts, event_id AS seq,
    CASE event_type WHEN 'error' THEN 'rate_limit' WHEN 'signup' THEN 'server_error'
                    WHEN 'purchase' THEN 'other_error' ELSE 'ok' END AS outcome,
    value AS latency, CAST(json_extract(props, '$.k') AS BIGINT) AS tokens
  FROM events)"""

WEB = r"""web AS (
  SELECT page_id, url, path, path || '/' || page_id AS page_path, lower(regexp_replace(path, '^[^/]*', '')) AS page_key, title FROM (
    SELECT page_id, url, regexp_replace(regexp_replace(url, '^[a-z]+://|[?#].*$', '', 'g'), '/$', '') AS path,
           regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages))"""

# Title ratio by longest common blocks, as a work list: the longest common piece of two texts (the
# earliest in x, then in y) counts, and what lies left and right of it is compared in the same way.
# Needs titles(pair, x, y); gives ratio(pair, r).
RATIO = """seg AS (
  SELECT pair, x, y, 0 AS matched FROM titles
  UNION ALL
  SELECT pair, c.x, c.y, c.m FROM (
    SELECT pair, unnest([{'x': x[:i - 1], 'y': y[:j - 1], 'm': l}, {'x': x[i + l:], 'y': y[j + l:], 'm': 0}]) AS c FROM (
      SELECT pair, x, y, best.l AS l, -best.i AS i, strpos(y, x[-best.i:best.l - best.i - 1]) AS j FROM (
        SELECT pair, x, y, list_max(list_filter(
          flatten(list_transform(range(1, length(x) + 1), lambda i: list_transform(range(1, length(x) - i + 2), lambda l: {'l': l, 'i': -i}))),
          lambda s: contains(y, x[-s.i:s.l - s.i - 1]))) AS best
        FROM seg WHERE x <> '' AND y <> '') WHERE best IS NOT NULL))),
ratio AS (SELECT pair, 2.0 * sum(matched) / any_value(length(t.x) + length(t.y)) AS r FROM seg JOIN titles t USING (pair) GROUP BY pair)"""

# Pairs of titles under one key; a blank title matches all. Needs keyed(page_path, page_key, title).
TITLE_PAIRS = f"""g AS (SELECT page_key, title, lower(title) AS low, count(*) AS n, min(page_path) AS first, max(page_path) AS last FROM keyed WHERE page_key <> '' GROUP BY 1, 2),
pr AS (
  SELECT a.page_key, a.title AS title_a, b.title AS title_b, a.low AS low_a, b.low AS low_b, a.first AS first_a, b.first AS first_b, a.n AS n_a, b.n AS n_b,
    b.first < a.last AS back, a.title = '' OR b.title = '' AS blank
  FROM g a JOIN g b ON a.page_key = b.page_key AND a.first < b.first),
titles AS (
  SELECT first_a || '>' || first_b AS pair, low_a AS x, low_b AS y FROM pr WHERE NOT blank AND 2 * least(length(low_a), length(low_b)) >= 0.7 * (length(low_a) + length(low_b))
  UNION ALL
  SELECT first_b || '>' || first_a, low_b, low_a FROM pr WHERE NOT blank AND back AND 2 * least(length(low_a), length(low_b)) >= 0.7 * (length(low_a) + length(low_b))),
{RATIO},
scored AS (
  SELECT pr.*, CASE WHEN blank THEN 1.0 ELSE r.r END AS similarity, CASE WHEN back THEN CASE WHEN blank THEN 1.0 ELSE q.r END END AS reverse
  FROM pr LEFT JOIN ratio r ON r.pair = first_a || '>' || first_b LEFT JOIN ratio q ON q.pair = first_b || '>' || first_a),
dup AS (
  SELECT page_key, title_a, title_b, first_a, first_b, n_a, n_b, similarity::DOUBLE AS similarity, reverse::DOUBLE AS reverse FROM scored
  WHERE similarity >= 0.7 - 1e-12 OR reverse >= 0.7 - 1e-12
  UNION ALL SELECT page_key, title, title, first, first, n, n, 1.0, 1.0 FROM g WHERE n > 1),
link AS (SELECT first_a AS a, first_b AS b FROM dup UNION SELECT first_b, first_a FROM dup),
reach AS (SELECT DISTINCT a, a AS b FROM link UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
dup_map AS (
  SELECT k.page_path, r.canonical FROM keyed k JOIN g ON g.page_key = k.page_key AND g.title = k.title JOIN (SELECT a, min(b) AS canonical FROM reach GROUP BY a) r ON r.a = g.first)"""
