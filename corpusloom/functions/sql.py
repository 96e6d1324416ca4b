"""The main text functions for Spark SQL, as temporary SQL functions.

They are plain SQL expressions, so queries that call them stay in the JVM.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from .. import constants as K


def _strip(expr: str) -> str:
    chars = "".join(f"\\u{ord(c):04x}" for c in K.WHITESPACE)
    return f"btrim({expr}, '{chars}')"


def _clean(expr: str) -> str:
    for pattern, repl in K.MARKDOWN_PASSES:
        expr = f"regexp_replace({expr}, r'{pattern}', '{repl}')"
    return _strip(expr)


def _sections(c: str) -> str:
    head = r"(?md)\A(#{1,6})\s+(.+)$"
    title = _strip(f"regexp_extract(s, r'{head}', 2)")
    body = f"regexp_replace(s, r'{head}', '')"
    rows = (
        f"filter(transform(filter(split({c}, r'(?md)(?=^#{{1,6}}\\s+.+$)'), s -> s <> ''), s -> named_struct("
        f"'level', length(regexp_extract(s, r'{head}', 1)), "
        f"'title', coalesce(nullif({title}, ''), '{K.PREAMBLE_TITLE}'), 'text', {_clean(body)})), r -> r.text <> '')"
    )
    one = f"array(named_struct('level', 0, 'title', '{K.PREAMBLE_TITLE}', 'text', w))"
    # a lambda's argument is worked out once
    whole = f"get(transform(array({_clean(c)}), w -> CASE WHEN w <> '' THEN {one} ELSE slice({one}, 1, 0) END), 0)"
    return f"get(transform(array({rows}), r -> CASE WHEN size(r) > 0 THEN r ELSE {whole} END), 0)"


def register(spark: SparkSession) -> None:
    """kb_clean_markdown, kb_wikilinks, kb_jaccard and the table function
    kb_sections (pos, level, title, text)."""
    make = "CREATE OR REPLACE TEMPORARY FUNCTION"
    spark.sql(f"{make} kb_clean_markdown(content STRING) RETURNS STRING RETURN {_clean('content')}")
    spark.sql(f"{make} kb_wikilinks(content STRING) RETURNS ARRAY<STRING> RETURN regexp_extract_all(content, r'{K.WIKILINK}', 1)")
    spark.sql(
        f"{make} kb_jaccard(a ARRAY<STRING>, b ARRAY<STRING>) RETURNS DOUBLE RETURN "
        "CASE WHEN size(a) = 0 OR size(b) = 0 THEN 0.0D ELSE size(array_intersect(a, b)) / size(array_union(a, b)) END")
    spark.sql(
        f"{make} kb_sections(content STRING) RETURNS TABLE (pos INT, level INT, title STRING, text STRING) RETURN "
        f"SELECT pos, s.level, s.title, s.text FROM (SELECT posexplode({_sections('kb_sections.content')}) AS (pos, s))")
