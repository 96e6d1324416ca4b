"""Queries on Markdown, sections, requests and answers."""

from pyspark.sql import functions as F

from .. import constants as K
from ..functions import markdown as M
from ..functions import paths as P
from ..functions import text as T
from ..operators import enrich as E
from ..operators import sections as X
from ..sources import corpus as S
from ..sources import tables
from .registry import MARKDOWN, NOTES, WEB, query

C = F.lit


def md5(c):
    return F.md5((F.col(c) if isinstance(c, str) else c).cast("binary"))


# ---- paths ----------------------------------------------------------------------------

@query("path_parts", rf"""WITH {WEB}, p AS (SELECT page_id, path, regexp_extract(path, '[^/]*$') AS base FROM web)
SELECT page_id, regexp_replace(path, '/?[^/]*$', '') AS dir, regexp_replace(base, '([^.])\.[^.]+$', '\1') AS stem,
  lower(regexp_extract(base, '[^.](\.[^.]+)$', 1)) AS ext,
  '2024-05-01-' || replace(regexp_replace(base, '([^.])\.[^.]+$', '\1'), ' ', '_') || '.md' AS page_file,
  lower(regexp_replace(base, '([^.])\.[^.]+$', '\1')) AS page_key
FROM p""")
def path_parts(spark, sf):
    w = S.web_pages(spark, sf)
    return w.select(
        "page_id", P.dirname("path").alias("dir"), P.stem("path").alias("stem"), P.suffix("path").alias("ext"),
        P.dated_name("path", "2024-05-01").alias("page_file"), P.page_key("path").alias("page_key"))


@query("path_targets", rf"""WITH {WEB}, p AS (SELECT page_id, path, regexp_replace(path, '([^./])\.[^./]+$', '\1') AS bare,
    string_split(regexp_replace(path, '([^./])\.[^./]+$', '\1'), '/') AS parts FROM web)
SELECT page_id, regexp_replace(path, '/?[^/]*$', '') AS category,
  CASE WHEN starts_with(path, 'm.') THEN 'source/' || path ELSE 'vault/' || path END AS portable,
  CASE WHEN len(parts) >= 3 THEN array_to_string(parts[-3:], '/') ELSE parts[-1] END AS link,
  replace(trim(link), ' ', '_') AS normal
FROM p""")
def path_targets(spark, sf):
    """Sites starting with ``m.`` lie outside the vault."""
    w = S.web_pages(spark, sf)
    full = F.when(F.startswith("path", C("m.")), F.concat(C("/src/"), "path")).otherwise(F.concat(C("/v/vault/"), "path"))
    link = P.link_target("path")
    return w.select(
        "page_id", P.source_category("path").alias("category"),
        P.portable_path(full, C("/v"), C("/src")).alias("portable"), link.alias("link"), P.normalize_link(link).alias("normal"))


@query("note_file_names", """SELECT doc_id, CASE WHEN rn = 1 THEN b || '.md' ELSE b || '_' || (rn - 1) || '.md' END AS file FROM (
  SELECT doc_id, lang || '/' || source || '/2024-05-01-' || n_chars // 100 AS b,
    row_number() OVER (PARTITION BY lang, source, n_chars // 100 ORDER BY doc_id) AS rn FROM documents)""")
def note_file_names(spark, sf):
    """Notes of one folder whose names clash get _1, _2, …"""
    d = S.table(spark, sf, "documents")
    rows = d.select("doc_id", F.concat_ws("/", "lang", "source").alias("dir"),
                    F.concat(C("2024-05-01-"), F.floor(F.col("n_chars") / 100).cast("string")).alias("base"))
    return tables.number_clashes(rows, "dir", "base", ["doc_id"]).select("doc_id", "file")


@query("content_hashes", "SELECT doc_id, md5(text) AS md5, sha256(text) AS sha256 FROM documents")
def content_hashes(spark, sf):
    return S.table(spark, sf, "documents").select("doc_id", md5("text").alias("md5"), F.sha2(F.col("text").cast("binary"), 256).alias("sha256"))


@query("table_to_text", r"""SELECT c_nationkey AS sheet, c_custkey // 1000 AS part, md5('## ' || c_nationkey || chr(10) || string_agg(
    c_custkey || ' | ' || c_name || ' | ' || c_mktsegment, chr(10) ORDER BY c_custkey)) AS text_md5, count(*) AS n
FROM customer GROUP BY 1, 2""")
def table_to_text(spark, sf):
    """One sheet per nation in parts of 1000 keys, rows pipe-joined in order."""
    c = S.table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_nationkey")
    lines = tables.row_text(c, ["c_custkey", "c_name", "c_mktsegment"]).filter("line IS NOT NULL")
    lines = lines.withColumn("part", F.floor(F.col("c_custkey") / 1000))
    out = tables.sheet_text(lines, ["c_nationkey", "part"], "c_custkey")
    return out.select(F.col("c_nationkey").alias("sheet"), "part", md5("text").alias("text_md5"), "n")


@query("table_lines", """SELECT o_orderkey, concat_ws(' | ', o_orderkey, o_custkey, o_orderstatus) AS line FROM orders""")
def table_lines(spark, sf):
    o = S.table(spark, sf, "orders")
    return tables.row_text(o, ["o_orderkey", "o_custkey", "o_orderstatus"]).select("o_orderkey", "line")


# ---- Markdown ---------------------------------------------------------------------------

SP = "' ' || chr(9) || chr(10) || chr(13)"


def clean_sql(c):
    for pat, rep in K.MARKDOWN_PASSES:
        rep = rep.replace("$", "\\")
        c = f"regexp_replace({c}, '{pat}', '{rep}', 'g')"
    return f"trim({c}, {SP})"


@query("md_clean", f"WITH {MARKDOWN} SELECT note_name, md5({clean_sql('content')}) AS text_md5 FROM md")
def md_clean(spark, sf):
    return S.markdown_pages(spark, sf).select("note_name", md5(M.clean_markdown("content")).alias("text_md5"))


@query("html_clean", f"SELECT page_id, md5({clean_sql('html')}) AS text_md5 FROM pages")
def html_clean(spark, sf):
    """The Markdown passes over raw pages (stars, hashes and > occur there)."""
    p = S.spread(S.table(spark, sf, "pages"))
    return p.select("page_id", md5(M.clean_markdown("html")).alias("text_md5"))


@query("md_sections", rf"""WITH {MARKDOWN},
s AS (SELECT note_name, unnest(p) AS s, unnest(range(len(p))) AS i FROM (
  SELECT note_name, list_filter(string_split(regexp_replace(content, '(?m)^(#{{1,6}}\s+[^\n]+)$', chr(1) || '\1', 'g'), chr(1)), lambda x: x <> '') AS p FROM md)),
r AS (SELECT note_name, i, length(regexp_extract(s, '^(#{{1,6}})\s+[^\n]+', 1)) AS level,
    coalesce(nullif(trim(regexp_extract(s, '^#{{1,6}}\s+([^\n]+)', 1), {SP}), ''), '概述') AS title,
    {clean_sql("regexp_replace(s, '^#{1,6}\\s+[^\\n]+', '')").replace('{{', '{')} AS text FROM s)
SELECT note_name, CAST(row_number() OVER (PARTITION BY note_name ORDER BY i) - 1 AS INTEGER) AS pos,
  CAST(level AS INTEGER) AS level, title, md5(text) AS text_md5
FROM r WHERE text <> ''""")
def md_sections(spark, sf):
    x = X.sections(S.markdown_pages(spark, sf))
    return x.select("note_name", "pos", "level", "title", md5("text").alias("text_md5"))


@query("frontmatter_fields", f"""WITH {MARKDOWN}
SELECT note_name, note_name || '.md' AS source, category, array_to_string(tags, '|') AS tags, category AS by_name,
  note_name AS title, len(tags) AS n_tags FROM md""")
def frontmatter_fields(spark, sf):
    p = S.markdown_pages(spark, sf)
    fm = M.parse_front_matter("content")
    return p.select(
        "note_name", fm["fields"]["source"].alias("source"), M.line_value("content", "category").alias("category"),
        F.array_join(fm["lists"]["tags"], "|").alias("tags"), M.front_field("content", "category").alias("by_name"),
        M.page_title("content", "rel_path").alias("title"), F.size(M.line_list("content", "tags")).cast("bigint").alias("n_tags"))


@query("tags_fill", f"""WITH {NOTES} SELECT note_name, CASE WHEN doc_id % 3 = 1 THEN 'tags: [x]' WHEN doc_id % 3 = 2 THEN 'no tags'
  ELSE CASE WHEN len(tags) > 0 THEN 'tags: [' || array_to_string(tags, ', ') || ']' ELSE 'tags: []' END || chr(10) || 'tags: []' END AS line FROM notes""")
def tags_fill(spark, sf):
    """Pages with empty tags twice, with tags, and without."""
    kind = F.when(F.col("doc_id") % 3 == 1, "tags: [x]").when(F.col("doc_id") % 3 == 2, "no tags").otherwise("tags: []\ntags: []")
    n = S.notes(spark, sf).withColumn("content", kind)
    return n.select("note_name", M.fill_empty_tags("content", "tags").alias("line"))


@query("sources_rewrite", """SELECT doc_id, md5('sources: [''' || source || ''', ''' || lang || ''']' || chr(10) || text || chr(10)
  || 'sources: [''' || source || ''', ''' || lang || ''']') AS content_md5 FROM documents""")
def sources_rewrite(spark, sf):
    d = S.spread(S.table(spark, sf, "documents")).withColumn(
        "content", F.concat(C("sources: [a, b]\n"), "text", C("\nsources: []")))
    return d.select("doc_id", md5(M.rewrite_list("content", "sources", F.array("source", "lang"), "'")).alias("content_md5"))


@query("tag_display", f"""WITH {NOTES} SELECT note_name,
  array_to_string(list_transform(list_slice(tags, 1, 3), lambda t: '`#' || t || '`'), ', ')
  || CASE WHEN len(tags) > 3 THEN ' 等' || len(tags) || '个' ELSE '' END AS shown FROM notes""")
def tag_display(spark, sf):
    return S.notes(spark, sf).select("note_name", T.tag_display("tags").alias("shown"))


@query("image_refs", """WITH r AS (SELECT doc_id, unnest(regexp_extract_all(
    '![a](' || source || '/' || doc_id || '.png) ' || text || ' ![b](https://x.org/' || doc_id || '.png) ![](i.svg)',
    '!\\[.*?\\]\\((.*?)\\)', 1)) AS ref FROM documents)
SELECT doc_id, ref FROM r WHERE NOT regexp_matches(ref, '^(http://|https://|data:)')""")
def image_refs(spark, sf):
    d = S.spread(S.table(spark, sf, "documents"))
    ident = F.col("doc_id").cast("string")
    text = F.concat(C("![a]("), "source", C("/"), ident, C(".png) "), "text", C(" ![b](https://x.org/"), ident, C(".png) ![](i.svg)"))
    return d.select("doc_id", F.explode(M.image_refs(text)).alias("ref"))


@query("note_render", f"""WITH {NOTES} SELECT note_name, md5('---' || chr(10) || 'source: ' || note_name || '.md' || chr(10)
  || 'date: 2024-05-01' || chr(10) || 'category: ' || category || chr(10) || 'tags: [' || array_to_string(tags, ', ') || ']' || chr(10)
  || 'original_path: ' || rel_path || chr(10) || '---' || chr(10) || chr(10) || '# ' || note_name || chr(10) || chr(10)
  || CASE WHEN summary <> '' THEN '## AI 摘要' || chr(10) || chr(10) || summary || chr(10) || chr(10) ELSE '' END
  || '## 文档大纲' || chr(10) || chr(10) || array_to_string(list_transform(tags, lambda t: '- ' || t), chr(10)) || chr(10) || chr(10)
  || '## 原始文件' || chr(10) || chr(10) || '- 原文：[[' || category || '/' || note_name || ']]' || chr(10) || chr(10) || chr(10)
  || CASE WHEN len(tags) > 0 THEN '## 标签' || chr(10) || chr(10)
     || array_to_string(list_transform(tags, lambda t: '`#' || t || '`'), ', ') || chr(10) || chr(10) ELSE '' END
  || chr(10) || '> 自动生成于 2024-05-01 00:00:00' || chr(10)) AS page_md5 FROM notes""")
def note_render(spark, sf):
    n = S.notes(spark, sf)
    page = M.render_page(
        F.concat("note_name", C(".md")), C("2024-05-01"), "category", "tags", "rel_path", "summary",
        F.transform("tags", lambda t: F.concat(C("- "), t)), C("2024-05-01 00:00:00"))
    return n.select("note_name", md5(page).alias("page_md5"))


@query("index_render", """WITH s AS (SELECT conv_id, turn // 500 AS part, list('cat/c' || conv_id || '_' || turn ORDER BY turn) AS l, list(role ORDER BY turn) AS r, count(*) AS n
  FROM conversations GROUP BY 1, 2)
SELECT conv_id, part, '---' || chr(10) || 'source: c' || conv_id || '.md' || chr(10) || 'date: 2024-05-01' || chr(10) || 'category: cat' || chr(10)
  || 'tags: []' || chr(10) || 'doc_type: index' || chr(10) || 'sections: ' || n || chr(10) || '---' || chr(10) || chr(10)
  || '# c' || conv_id || chr(10) || chr(10) || '## 目录' || chr(10) || chr(10)
  || array_to_string(list_transform(list_zip(l, r), lambda x: '- [[' || x[1] || '|' || regexp_extract(x[1], '[^/]*$') || ']] ' || x[2] || chr(10)), chr(10))
  || chr(10) || chr(10) || '---' || chr(10) || '> 自动生成于 t' || chr(10) AS page FROM s""")
def index_render(spark, sf):
    """Conversations as long documents, their turns as sections, up to 500
    links per index page."""
    c = S.table(spark, sf, "conversations")
    link = F.concat(C("cat/c"), F.col("conv_id").cast("string"), C("_"), F.col("turn").cast("string"))
    links = c.groupBy("conv_id", F.floor(F.col("turn") / 500).alias("part")).agg(F.sort_array(F.collect_list(F.struct("turn", link.alias("link"), F.col("role").alias("title")))).alias("links"))
    src = F.concat(C("c"), F.col("conv_id").cast("string"), C(".md"))
    none = F.array().cast("array<string>")
    page = M.render_index(src, C("2024-05-01"), C("cat"), none, "links", C(""), C(None).cast("string"), C("t"))
    return links.select("conv_id", "part", page.alias("page"))


@query("child_render", """SELECT conv_id, turn, md5('---' || chr(10) || 'source: c' || conv_id || '.md' || chr(10) || 'date: 2024-05-01' || chr(10) || 'category: cat' || chr(10)
  || 'tags: []' || chr(10) || 'parent: cat/c' || conv_id || chr(10) || '---' || chr(10) || chr(10) || '# ' || role || chr(10) || chr(10)
  || CASE WHEN text <> '' THEN text || chr(10) || chr(10) || chr(10) ELSE '' END
  || chr(10) || '> 返回 [[cat/c' || conv_id || '|c' || conv_id || ']]' || chr(10) || chr(10) || '> 自动生成于 t' || chr(10)) AS page_md5
FROM conversations""")
def child_render(spark, sf):
    c = S.table(spark, sf, "conversations")
    conv = F.col("conv_id").cast("string")
    none = F.array().cast("array<string>")
    page = M.render_child(
        F.concat(C("c"), conv, C(".md")), C("2024-05-01"), C("cat"), none, F.concat(C("cat/c"), conv),
        C(None).cast("string"), "role", C(""), "text", none, C("t"))
    return c.select("conv_id", "turn", md5(page).alias("page_md5"))


@query("related_section", f"""WITH {NOTES}, p AS (SELECT note_name, tags,
  CASE WHEN n_chars >= 1000 THEN summary || chr(10) || '## 相关文档' || chr(10) || '- [[old]]' || chr(10) || chr(10) || '## z'
       WHEN n_chars >= 500 THEN summary || chr(10) || '> 自动生成于 t' ELSE summary || '  ' || chr(10) END AS content, summary, n_chars,
  chr(10) || '## 相关文档' || chr(10) || array_to_string(list_transform(tags, lambda t: '- [[' || t || ']]' || chr(10)), '') AS block FROM notes)
SELECT note_name, md5(CASE WHEN len(tags) = 0 THEN content WHEN n_chars >= 1000 THEN summary || block || chr(10) || '## z'
  WHEN n_chars >= 500 THEN summary || block || chr(10) || '> 自动生成于 t'
  ELSE rtrim(content, {SP}) || block || chr(10) END) AS content_md5 FROM p""")
def related_section(spark, sf):
    """All three places for the related-pages section, by text length."""
    d = S.spread(S.table(spark, sf, "documents"))
    content = (
        F.when(F.col("n_chars") >= 1000, F.concat("text", C("\n## 相关文档\n- [[old]]\n\n## z")))
        .when(F.col("n_chars") >= 500, F.concat("text", C("\n> 自动生成于 t"))).otherwise(F.concat("text", C("  \n"))))
    p = d.select(F.concat(C("d"), F.col("doc_id").cast("string")).alias("note_name"), T.longest_tokens("text").alias("tags"), content.alias("content"))
    return p.select("note_name", md5(M.put_related("content", "tags")).alias("content_md5"))


@query("legacy_migrate", """SELECT doc_id, md5(CASE WHEN n_chars >= 1000 THEN text || chr(10) || '## 原始文件' || chr(10) || '- 原文：[[d' || doc_id || ']]' || chr(10) || chr(10)
  WHEN n_chars >= 500 THEN text || chr(10) || '## 原始文件' || chr(10) || '- 原文：[[f.' || source || ']]' || chr(10) || chr(10)
  ELSE text || chr(10) || '## 原始文件' || chr(10) || '- 原文：[[' || source || ']]' || chr(10) || chr(10) END) AS content_md5
FROM documents""")
def legacy_migrate(spark, sf):
    """The three old reference blocks, by text length."""
    d = S.spread(S.table(spark, sf, "documents"))
    content = (
        F.when(F.col("n_chars") >= 1000, F.concat("text", C("\n## 原文位置\n- 原文：`a.pdf`\n- 路径：`/x/a.pdf`\n")))
        .when(F.col("n_chars") >= 500, F.concat("text", C("\n## 原始文件\n- 文件名：`f."), "source", C(".pdf`\n- 源路径：`/x`\n\n")))
        .otherwise(F.concat("text", C("\n## 原始文件\n- 文件名：`"), "source", C(".doc`\n\n"))))
    path = F.concat(C("x/d"), F.col("doc_id").cast("string"), C(".md"))
    return d.select("doc_id", md5(M.migrate_references(content, path)).alias("content_md5"))


# ---- keywords -----------------------------------------------------------------------------

@query("keyword_sets", r"""SELECT doc_id, len(list_distinct(regexp_extract_all(text, '\p{L}{2,4}'))) AS n,
  md5(array_to_string(list_sort(list_distinct(regexp_extract_all(text, '\p{L}{2,4}'))), ',')) AS words_md5 FROM documents""")
def keyword_sets(spark, sf):
    d = S.spread(S.table(spark, sf, "documents")).select("doc_id", T.keywords("text", S.LATIN_KEYWORD).alias("w"))
    return d.select("doc_id", F.size("w").cast("bigint").alias("n"), md5(F.array_join(F.sort_array("w"), ",")).alias("words_md5"))


TILED = r"""list_distinct(list_concat(list_concat(regexp_extract_all(text, '\p{L}{2}'), regexp_extract_all(text, '\p{L}{3}')),
  list_concat(regexp_extract_all(text, '\p{L}{4}'), regexp_extract_all(source, '\p{L}{2,6}'))))"""


@query("tiled_keyword_sets", f"""SELECT doc_id, len({TILED}) AS n, md5(array_to_string(list_sort({TILED}), ',')) AS words_md5 FROM documents""")
def tiled_keyword_sets(spark, sf):
    d = S.spread(S.table(spark, sf, "documents")).select("doc_id", T.tiled_keywords("text", "source", r"\p{L}").alias("w"))
    return d.select("doc_id", F.size("w").cast("bigint").alias("n"), md5(F.array_join(F.sort_array("w"), ",")).alias("words_md5"))


# ---- sections and runs ------------------------------------------------------------------------

@query("section_batches", """SELECT conv_id, turn // 5 AS batch, md5(string_agg(text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY turn) FILTER (text <> '')) AS text_md5,
  count(*) AS n FROM conversations GROUP BY ALL HAVING bool_or(trim(text) <> '')""")
def section_batches(spark, sf):
    b = X.batch_sections(S.table(spark, sf, "conversations"), "conv_id", "turn", "text")
    return b.select("conv_id", "batch", md5("combined").alias("text_md5"), "n")


@query("section_shared", """WITH b AS (SELECT conv_id, turn // 5 AS batch, max(length(text)) AS longest FROM conversations GROUP BY ALL)
SELECT c.conv_id, c.turn, longest FROM conversations c JOIN b ON b.conv_id = c.conv_id AND b.batch = c.turn // 5""")
def section_shared(spark, sf):
    """Every section gets the one answer of its batch."""
    c = S.table(spark, sf, "conversations")
    answers = c.groupBy("conv_id", F.floor(F.col("turn") / 5).alias("batch")).agg(F.max(F.length("text")).cast("bigint").alias("longest"))
    return X.share_summaries(c.select("conv_id", "turn"), answers, "conv_id", "turn")


@query("overview_input", """SELECT conv_id, turn // 50 AS part, md5(string_agg(text || chr(10), '' ORDER BY turn) FILTER (text <> '')) AS text_md5
FROM conversations GROUP BY ALL HAVING bool_or(trim(text) <> '')""")
def overview_input(spark, sf):
    o = X.overview_parts(S.table(spark, sf, "conversations"), "conv_id", "turn", "text")
    return o.select("conv_id", "part", md5("text").alias("text_md5"))


@query("outline_input", """SELECT conv_id, turn // 50 AS part, md5(string_agg(role || CASE WHEN text <> '' THEN ': ' || text ELSE '' END, chr(10) ORDER BY turn)) AS text_md5
FROM conversations GROUP BY ALL""")
def outline_input(spark, sf):
    o = X.outline_parts(S.table(spark, sf, "conversations"), "conv_id", "turn", "role", "text")
    return o.select("conv_id", "part", md5("text").alias("text_md5"))


@query("doc_totals", "SELECT conv_id, count(*) AS n_sections, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM conversations GROUP BY 1")
def doc_totals(spark, sf):
    return X.totals(S.table(spark, sf, "conversations"), "conv_id", "text")


RUN_TITLE = r"[A-Z]\p{L}{2,29}"


@query("page_runs", rf"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS page, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents),
t AS (SELECT doc_id, i, page, CASE WHEN trim(page) <> '' AND NOT regexp_matches(trim(page), '^\d+$')
    AND length(regexp_extract(trim(page), '^[A-Z]\p{{L}}')) = 2 THEN regexp_extract(trim(page), '^[A-Z]\p{{L}}') ELSE 'p' || i END AS title FROM l),
c AS (SELECT *, CASE WHEN lag(title) OVER (PARTITION BY doc_id ORDER BY i) = title THEN 0 ELSE 1 END AS brk FROM t),
r AS (SELECT *, sum(brk) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM c)
SELECT doc_id, CAST(run - 1 AS INTEGER) AS run, any_value(title) AS title, md5(string_agg(page, chr(10) || chr(10) ORDER BY i)) AS text_md5,
  CAST(count(*) AS INTEGER) AS n_pages FROM r GROUP BY doc_id, run""")
def page_runs(spark, sf):
    """Lines as pages; a page's title is the capital start of its line."""
    d = S.spread(S.table(spark, sf, "documents")).select("doc_id", F.split("text", "\n").alias("pages"))
    d = d.withColumn("given", F.transform("pages", lambda p, i: F.concat(C("p"), i.cast("string"))))
    d = d.withColumn("titles", X.infer_titles("pages", "given", r"^[A-Z]\p{L}", low=2))
    return X.merge_runs(d, "doc_id", "pages", "titles").select("doc_id", "run", "title", md5("text").alias("text_md5"), "n_pages")


@query("route_docs", """WITH s AS (SELECT conv_id, count(*) AS s, sum(length(text)) AS c FROM conversations GROUP BY 1)
SELECT conv_id, CASE WHEN s >= 3 OR (c >= 3000 AND s > 0) THEN 'long' ELSE 'short' END AS strategy,
  s >= 5 OR c >= 10000 AS large, s >= 3 OR c >= 3000 AS split FROM s""")
def route_docs(spark, sf):
    t = X.totals(S.table(spark, sf, "conversations"), "conv_id", "text")
    return t.select("conv_id", X.strategy("n_chars", "n_sections").alias("strategy"),
                    X.is_large("n_chars", "n_sections").alias("large"), X.should_split("n_chars", "n_sections").alias("split"))


@query("ocr_gate", """SELECT page_id, length(trim(html, ' ' || chr(10))) * 1.0 / greatest(len(regexp_extract_all(html, '<p>')), 1) < 100
  AND len(regexp_extract_all(html, '<li>')) > 0 AS ocr FROM pages""")
def ocr_gate(spark, sf):
    """Paragraphs as pages, list items as images."""
    p = S.spread(S.table(spark, sf, "pages")).select(
        "page_id", "html", F.size(F.regexp_extract_all("html", C("<p>"), C(0))).alias("n"),
        F.size(F.regexp_extract_all("html", C("<li>"), C(0))).alias("img"))
    return p.select("page_id", X.needs_ocr("html", "n", "img").alias("ocr"))


@query("image_context", """WITH i AS (SELECT conv_id, turn, CASE WHEN role = 'user' THEN trim(text, ' ' || chr(10))
    WHEN turn < 3 THEN 'seen ' || turn ELSE '' END AS d FROM conversations),
c AS (SELECT conv_id, string_agg('[图片' || (turn + 1) || '] ' || d, chr(10) || chr(10) ORDER BY turn) FILTER (d <> '') AS ctx FROM i GROUP BY 1)
SELECT i.conv_id, i.turn, md5(CASE WHEN ctx IS NULL THEN t.text ELSE t.text || chr(10) || chr(10) || '[文档图片]' || chr(10) || ctx END) AS text_md5, md5(d) AS description_md5
FROM i JOIN conversations t ON t.conv_id = i.conv_id AND t.turn = i.turn LEFT JOIN c ON c.conv_id = i.conv_id""")
def image_context(spark, sf):
    """Turns as images: user turns carry text, a recogniser answers for the
    first three images."""
    c = S.table(spark, sf, "conversations")
    img = c.withColumn("pos", F.col("turn")).withColumn("ocr", F.when(F.col("role") == "user", F.col("text")).otherwise(""))
    d = X.describe_images(img, F.concat(C("seen "), F.col("turn").cast("string")), limit=3)
    out = X.with_image_context(d, X.image_context(d, "conv_id"), "conv_id", "text")
    return out.select("conv_id", "turn", md5("text").alias("text_md5"), md5("description").alias("description_md5"))


# ---- requests and answers --------------------------------------------------------------------------

@query("request_parts", """WITH p AS (SELECT doc_id, text, length(text) >= 200 AS send,
    CASE WHEN length(text) >= 200 THEN greatest(CAST(ceil(length(text) / 8000.0) AS INTEGER), 1) ELSE 1 END AS n FROM documents)
SELECT doc_id, 'summary' AS kind, send, CAST(i AS INTEGER) AS part,
  md5(CASE WHEN send THEN substr(text, i * 8000 + 1, 8000) ELSE trim(text, ' ' || chr(10)) END) AS body_md5
FROM (SELECT *, unnest(range(n)) AS i FROM p)""")
def request_parts(spark, sf):
    r = X.build_requests(S.spread(S.table(spark, sf, "documents")), "doc_id", "text", "summary")
    return r.select("doc_id", "kind", "send", "part", md5("body").alias("body_md5"))


LONGEST = """SELECT doc_id, part, CASE WHEN NOT send THEN body ELSE array_to_string(list_transform(list_sort(list_transform(
   list_slice(list_sort(list_transform(string_split(body, '. '), lambda s, i: {'l': -length(s), 'i': i, 's': s})), 1, 3),
   lambda e: {'i': e.i, 's': e.s})), lambda e: e.s), '. ') END AS answer FROM q"""


@query("enrich_summaries", f"""WITH p AS (SELECT doc_id, text, length(text) >= 200 AS send,
    CASE WHEN length(text) >= 200 THEN greatest(CAST(ceil(length(text) / 8000.0) AS INTEGER), 1) ELSE 1 END AS n FROM documents),
q AS (SELECT doc_id, send, CAST(i AS INTEGER) AS part,
  CASE WHEN send THEN substr(text, i * 8000 + 1, 8000) ELSE trim(text, ' ' || chr(10)) END AS body
  FROM (SELECT *, unnest(range(n)) AS i FROM p)),
a AS ({LONGEST})
SELECT doc_id, part, md5(answer) AS answer_md5, true AS fine FROM a""")
def enrich_summaries(spark, sf):
    r = X.build_requests(S.spread(S.table(spark, sf, "documents")), "doc_id", "text", "summary")
    a = E.enrich(r, E.longest_sentences, ["doc_id", "part"])
    return a.select("doc_id", "part", md5("answer").alias("answer_md5"), F.col("error").isNull().alias("fine"))


@query("enhanced_context", f"""WITH {NOTES}, d AS (SELECT doc_id, category, tags, CASE WHEN n_chars >= 500 THEN category ELSE '' END AS hint, summary FROM notes)
SELECT doc_id, md5(CASE WHEN hint = '' AND len(tags) = 0 THEN summary ELSE '【结构分析结果】' || chr(10) || concat_ws(chr(10) || chr(10),
   CASE WHEN hint <> '' THEN '文档核心概述: ' || hint END,
   CASE WHEN len(tags) > 0 THEN '关键论点:' || chr(10) || array_to_string(list_transform(tags, lambda t: '- ' || t), chr(10)) END,
   CASE WHEN len(tags) > 0 THEN '涉及概念: ' || array_to_string(tags, ', ') END)
   || chr(10) || chr(10) || '【文档原文】' || chr(10) || summary END) AS body_md5 FROM d""")
def enhanced_context(spark, sf):
    d = S.spread(S.table(spark, sf, "documents"))
    n = d.select(
        "doc_id", "text", T.longest_tokens("text").alias("points"), F.array().cast("array<string>").alias("entities"),
        F.when(F.col("n_chars") >= 500, F.concat_ws("/", "lang", "source")).otherwise("").alias("hint"))
    n = n.withColumn("concepts", F.col("points"))
    return n.select("doc_id", md5(X.enhanced_context("hint", "points", "entities", "concepts", "text")).alias("body_md5"))


@query("response_parse", """SELECT conv_id, turn,
  CASE WHEN length(text) < 100 THEN '短文本' WHEN role = 'user' THEN '未知' ELSE 'turn' END AS doc_type,
  CASE WHEN length(text) >= 100 AND role <> 'user' THEN role ELSE '' END AS entities,
  CASE WHEN length(text) < 100 OR role = 'user' THEN text ELSE 'h' || turn END AS hint FROM conversations""")
def response_parse(spark, sf):
    """Answers: fenced JSON from assistants, plain text from users."""
    c = S.table(spark, sf, "conversations")
    js = F.concat(C('```json\n{"doc_type": "turn", "entities": ["'), "role", C('"], "summary_hint": "h'), F.col("turn").cast("string"), C('"}\n```'))
    p = X.parse_structure(F.when(F.col("role") == "user", F.col("text")).otherwise(js), "text")
    return c.select("conv_id", "turn", p["doc_type"].alias("doc_type"), F.array_join(p["entities"], ",").alias("entities"), p["summary_hint"].alias("hint"))


@query("tag_clean", r"""WITH r AS (SELECT conv_id, turn, list_slice(list_filter(list_transform(string_split(replace(text, '，', ','), ','),
    lambda t: trim(t, ' ' || chr(10))), lambda t: t <> ''), 1, 8) AS raw FROM conversations),
c AS (SELECT conv_id, turn, list_filter(list_transform(raw, lambda t: trim(t, '[]''"。')), lambda t: length(t) BETWEEN 2 AND 20) AS l FROM r)
SELECT conv_id, turn, array_to_string(list_slice(list_transform(list_sort(list_transform(list_distinct(l),
    lambda t: {'p': list_position(l, t), 't': t})), lambda e: e.t), 1, 8), '|') AS tags FROM c""")
def tag_clean(spark, sf):
    c = S.table(spark, sf, "conversations")
    return c.select("conv_id", "turn", F.array_join(T.clean_tags(T.split_tags("text")), "|").alias("tags"))


@query("outline_parse", r"""WITH s AS (SELECT conv_id, turn, string_split(trim(CASE WHEN role = 'user' THEN text ELSE '- ' || replace(text, chr(10), chr(10) || '- ') END, ' ' || chr(10)), chr(10)) AS l, text FROM conversations),
o AS (SELECT conv_id, turn, list_slice(list_filter(l, lambda x: starts_with(x, '- ') AND length(trim(x, ' ' || chr(10))) > 2), 1, 30) AS o, string_split(text, ' ') AS w FROM s)
SELECT conv_id, turn, md5(array_to_string(CASE WHEN len(o) > 0 THEN o ELSE list_transform(list_slice(list_transform(list_sort(list_transform(
   list_distinct(list_filter(w, lambda t: length(t) > 3)), lambda t: {'p': list_position(w, t), 't': t})), lambda e: e.t), 1, 20), lambda t: '- ' || t) END, chr(10))) AS outline_md5 FROM o""")
def outline_parse(spark, sf):
    """Assistant turns answer as lists; for user turns the titles are used."""
    c = S.table(spark, sf, "conversations").withColumn("titles", F.split("text", " "))
    answer = F.when(F.col("role") == "user", F.col("text")).otherwise(F.concat(C("- "), F.replace(F.col("text"), C("\n"), C("\n- "))))
    return c.select("conv_id", "turn", md5(F.array_join(T.outline_lines(answer, "titles"), "\n")).alias("outline_md5"))


@query("reasoning_strip", r"""WITH r AS (SELECT conv_id, turn, text, CASE WHEN turn = 0 THEN 'x<|end_of_thought|> ' || text
  WHEN role = 'user' THEN 'y</think>' || text ELSE text END AS raw FROM conversations)
SELECT conv_id, turn, md5(CASE WHEN turn = 0 OR role_user THEN CASE WHEN trim(text, ' ' || chr(10)) <> '' THEN trim(text, ' ' || chr(10)) ELSE raw END ELSE raw END) AS answer_md5
FROM (SELECT r.*, c.role = 'user' AS role_user FROM r JOIN conversations c USING (conv_id, turn))""")
def reasoning_strip(spark, sf):
    c = S.table(spark, sf, "conversations")
    raw = (F.when(F.col("turn") == 0, F.concat(C("x<|end_of_thought|> "), "text"))
           .when(F.col("role") == "user", F.concat(C("y</think>"), "text")).otherwise(F.col("text")))
    return c.select("conv_id", "turn", md5(T.after_reasoning(raw)).alias("answer_md5"))


@query("label_snap", """SELECT doc_id, CASE WHEN contains(source, 'src1') OR contains('src1', source) THEN 'src1'
  WHEN contains(source, 'src2') OR contains('src2', source) THEN 'src2' ELSE 'other' END AS label FROM documents""")
def label_snap(spark, sf):
    d = S.table(spark, sf, "documents")
    return d.select("doc_id", T.snap_label("source", ["src1", "src2"], "other").alias("label"))


@query("note_sink", "SELECT lang || '/' || source AS category, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM documents GROUP BY 1")
def note_sink(spark, sf):
    """Pages written by category and read back."""
    d = S.table(spark, sf, "documents").select(F.concat_ws("/", "lang", "source").alias("category"), "doc_id", F.col("text").alias("content"))
    back = tables.write_pages(d)
    return back.groupBy("category").agg(F.count("*").alias("n"), F.sum(F.length("content")).alias("n_chars"))




@query("has_content", """WITH t AS (SELECT conv_id, string_agg(text, '' ORDER BY turn) FILTER (role = 'user') AS text,
  count(*) FILTER (role <> 'user') AS s FROM conversations GROUP BY 1)
SELECT conv_id, coalesce(trim(text, ' ' || chr(10)) <> '', false) OR s > 0 AS content FROM t""")
def has_content(spark, sf):
    """User text as text, other turns as sections; blank text is no content."""
    c = S.table(spark, sf, "conversations")
    user = F.col("role") == "user"
    # whether any part has text is all that matters, so nothing is concatenated
    t = c.groupBy("conv_id").agg(
        F.max(F.when(user & (T.strip("text") != ""), "x").otherwise("")).alias("text"), F.count_if(~user).alias("s"), C(0).alias("i"))
    return t.select("conv_id", X.has_content("text", "i", "s").alias("content"))


@query("md_sections_sql", rf"""WITH {MARKDOWN},
s AS (SELECT note_name, unnest(p) AS s, unnest(range(len(p))) AS i FROM (
  SELECT note_name, list_filter(string_split(regexp_replace(content, '(?m)^(#{{1,6}}\s+[^\n]+)$', chr(1) || '\1', 'g'), chr(1)), lambda x: x <> '') AS p FROM md)),
r AS (SELECT note_name, i, length(regexp_extract(s, '^(#{{1,6}})\s+[^\n]+', 1)) AS level,
    {clean_sql("regexp_replace(s, '^#{1,6}\\s+[^\\n]+', '')")} AS text FROM s)
SELECT note_name, CAST(count(*) AS BIGINT) AS n, CAST(sum(level) AS BIGINT) AS levels, CAST(sum(length(text)) AS BIGINT) AS n_chars
FROM r WHERE text <> '' GROUP BY 1""")
def md_sections_by_sql(spark, sf):
    """The section splitter as a table function of Spark SQL."""
    from ..functions import sql

    sql.register(spark)
    S.markdown_pages(spark, sf).createOrReplaceTempView("kb_markdown_pages")
    return spark.sql("""SELECT note_name, count(*) AS n, sum(level) AS levels, sum(length(text)) AS n_chars
        FROM kb_markdown_pages, LATERAL kb_sections(content) GROUP BY note_name""")
