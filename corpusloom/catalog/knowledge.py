"""Queries on notes, links, state tables and index pages."""

from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import text as T
from ..operators import cascade, incremental, links, moc, related
from ..sources import corpus as S
from .registry import CALLS, NOTES, PAGES, WEB, query


def joined(c):
    return F.array_join(c, ",")


# ---- related documents -----------------------------------------------------------

RELATED = rf"""WITH {NOTES},
n AS (SELECT note_name, category, tags, list_distinct(regexp_extract_all(summary, '\p{{L}}{{2,4}}')) AS kw FROM notes),
t AS (SELECT note_name, unnest(tags) AS tag FROM n),
p AS (SELECT a.note_name AS a, b.note_name AS b, count(*) AS shared
      FROM t a JOIN t b ON a.tag = b.tag AND a.note_name <> b.note_name GROUP BY ALL),
j AS (SELECT p.a, p.b, p.shared, x.category = y.category AS same, len(x.kw) AS na, len(y.kw) AS nb,
             len(list_intersect(x.kw, y.kw)) AS i
      FROM p JOIN n x ON x.note_name = p.a JOIN n y ON y.note_name = p.b),
s AS (SELECT a, b, 3.0 * shared + CASE WHEN same THEN 1.0 ELSE 0.0 END
             + CASE WHEN na = 0 OR nb = 0 THEN 0 ELSE 0.5 * i / (na + nb - i)::DOUBLE END AS score FROM j),
r AS (SELECT a AS note_name, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS rank,
             b AS other_name, round(score, 6)::DOUBLE AS score FROM s WHERE score >= 2)
SELECT note_name, CAST(rank AS INTEGER) AS rank, other_name, score FROM r WHERE rank <= 5"""


@query("related_docs", RELATED)
def related_docs(spark, sf):
    r = related.related_docs(S.notes(spark, sf), pattern=S.LATIN_KEYWORD)
    return r.withColumn("score", F.round("score", 6))


# ---- content state ------------------------------------------------------------------

@query("exact_dup_groups", "SELECT md5(text) AS md5, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1")
def exact_dup_groups(spark, sf):
    return incremental.exact_groups(S.table(spark, sf, "documents"), "doc_id", "text")


def hashed(spark, sf):
    return S.table(spark, sf, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("md5"))


@query("skip_known", """WITH h AS (SELECT doc_id, md5(text) AS md5 FROM documents)
SELECT doc_id, md5 FROM h WHERE md5 NOT IN (SELECT md5 FROM h JOIN labels USING (doc_id))""")
def skip_known(spark, sf):
    """Known content = the labelled documents; the batch is the whole table."""
    h = hashed(spark, sf)
    return incremental.skip_known(h, h.join(S.table(spark, sf, "labels"), "doc_id"))


@query("skip_known_first", """WITH h AS (SELECT doc_id, md5(text) AS md5 FROM documents)
SELECT min(doc_id) AS doc_id, md5 FROM h WHERE md5 NOT IN (SELECT md5 FROM h JOIN labels USING (doc_id)) GROUP BY md5""")
def skip_known_first(spark, sf):
    h = hashed(spark, sf)
    index = h.join(S.table(spark, sf, "labels"), "doc_id")
    return incremental.skip_known(h, index, within_batch=True, order=[F.col("doc_id").asc()])


@query("known_content", """WITH h AS (SELECT doc_id, md5(text) AS md5, source FROM documents),
i AS (SELECT md5, min(doc_id) AS known_id FROM h JOIN labels USING (doc_id) GROUP BY md5)
SELECT h.md5, doc_id, known_id FROM h JOIN i USING (md5)""")
def known_content(spark, sf):
    h = hashed(spark, sf)
    index = h.join(S.table(spark, sf, "labels"), "doc_id").groupBy("md5").agg(F.min("doc_id").alias("known_id"))
    return incremental.known(h, index)


def inventory(spark, sf):
    d = S.table(spark, sf, "documents")
    return d.select(
        "doc_id", F.concat_ws("/", "lang", "source", F.concat(F.lit("d"), F.col("doc_id"), F.lit(".md"))).alias("path"),
        F.md5(F.col("text").cast("binary")).alias("md5"), F.sha2(F.col("text").cast("binary"), 256).alias("sha256"),
        F.col("n_chars").alias("size"), F.concat_ws("/", "lang", "source").alias("category"),
    )


def old_status(spark, sf):
    """Labelled documents were seen before; quality 0 with another content."""
    inv, lab = inventory(spark, sf), S.table(spark, sf, "labels")
    return inv.join(lab, "doc_id").select(
        "path", F.when(F.col("toxic") == 1, "failed").otherwise("success").alias("status"),
        F.when(F.col("quality") == 1, F.col("md5")).otherwise(F.md5(F.col("md5").cast("binary"))).alias("md5"),
        F.when(F.col("quality") == 1, F.col("sha256")).otherwise("stale").alias("sha256"),
        "size", "category",
    )


INVENTORY = """inv AS (SELECT doc_id, lang || '/' || source || '/d' || doc_id || '.md' AS path, md5(text) AS md5,
  sha256(text) AS sha256, n_chars AS size, lang || '/' || source AS category FROM documents),
old AS (SELECT path, CASE WHEN toxic = 1 THEN 'failed' ELSE 'success' END AS status,
  CASE WHEN quality = 1 THEN md5 ELSE md5(md5) END AS md5,
  CASE WHEN quality = 1 THEN sha256 ELSE 'stale' END AS sha256, size, category FROM inv JOIN labels USING (doc_id))"""


@query("change_detect", f"""WITH {INVENTORY}
SELECT inv.path, old.status AS prev_status, CASE WHEN old.path IS NULL THEN 'new'
  WHEN inv.md5 = old.md5 AND inv.size = old.size THEN 'same' ELSE 'changed' END AS change
FROM inv LEFT JOIN old ON inv.path = old.path""")
def change_detect(spark, sf):
    return incremental.detect_changes(inventory(spark, sf), old_status(spark, sf))


@query("cache_lookup", f"""WITH {INVENTORY}
SELECT inv.path, coalesce(inv.sha256 = old.sha256, false) AS hit,
  CASE WHEN inv.sha256 = old.sha256 THEN old.category END AS cached_category
FROM inv LEFT JOIN old ON inv.path = old.path""")
def cache_lookup(spark, sf):
    return incremental.cache_lookup(inventory(spark, sf), old_status(spark, sf))


@query("cache_put", f"""WITH {INVENTORY}
SELECT path, sha256, category FROM inv
UNION ALL SELECT path, sha256, category FROM old WHERE path NOT IN (SELECT path FROM inv)""")
def cache_put(spark, sf):
    cols = ["path", "sha256", "category"]
    return incremental.replace_rows(old_status(spark, sf).select(*cols), inventory(spark, sf).select(*cols), ["path"])


@query("cache_invalidate", f"""WITH {INVENTORY}
SELECT path, sha256 FROM old WHERE path NOT IN (SELECT path FROM old WHERE status = 'failed')""")
def cache_invalidate(spark, sf):
    old = old_status(spark, sf)
    return incremental.cache_invalidate(old.select("path", "sha256"), old.filter("status = 'failed'"))


@query("cache_get", f"""WITH {INVENTORY}
SELECT path, sha256 FROM old WHERE path IN (SELECT path FROM inv WHERE size >= 1000)""")
def cache_get(spark, sf):
    return incremental.cache_get(
        old_status(spark, sf).select("path", "sha256"), inventory(spark, sf).filter("size >= 1000"))


@query("cache_stats", f"""WITH {INVENTORY} SELECT count(*) AS total,
CAST(sum(strlen(path) + strlen(sha256) + strlen(category)) AS BIGINT) AS bytes FROM old""")
def cache_stats(spark, sf):
    return incremental.cache_stats(old_status(spark, sf))


def status_log(spark, sf):
    status = (
        F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "signup", "updated")
        .when(F.col("event_type") == "view", "unchanged").otherwise("success"))
    return S.table(spark, sf, "events").select("user_id", status.alias("status"), "ts", "event_id")


STATUS = """lg AS (SELECT user_id, CASE event_type WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'updated'
  WHEN 'view' THEN 'unchanged' ELSE 'success' END AS status, ts, event_id FROM events),
last AS (SELECT user_id, status, event_id FROM lg
  QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1)"""


def current_status(spark, sf):
    """The log of successes merged with the log of everything else."""
    log = status_log(spark, sf)
    newest = [F.col("ts").desc(), F.col("event_id").desc()]
    return incremental.upsert_latest(log.filter("status = 'success'"), log.filter("status <> 'success'"), ["user_id"], newest)


@query("status_latest", f"WITH {STATUS} SELECT user_id, status, event_id FROM last")
def status_latest(spark, sf):
    return current_status(spark, sf).select("user_id", "status", "event_id")


@query("status_summary", f"""WITH {STATUS}, k AS (SELECT unnest(['success', 'failed', 'updated', 'unchanged']) AS status)
SELECT k.status, count(last.user_id) AS n FROM k LEFT JOIN last USING (status) GROUP BY 1""")
def status_summary(spark, sf):
    return incremental.status_summary(current_status(spark, sf))


@query("dedup_index_add", """WITH d AS (SELECT md5(text) AS md5, 'd' || doc_id || '.md' AS filename,
  lang || '/' || source AS category, doc_id FROM documents)
SELECT md5, arg_max(filename, doc_id) AS filename, arg_max(category, doc_id) AS category FROM d GROUP BY md5""")
def dedup_index_add(spark, sf):
    """Labelled documents are the index, all documents are added; last wins."""
    d = S.table(spark, sf, "documents").select(
        "doc_id", F.md5(F.col("text").cast("binary")).alias("md5"),
        F.concat(F.lit("d"), "doc_id", F.lit(".md")).alias("filename"), F.concat_ws("/", "lang", "source").alias("category"))
    base = d.join(S.table(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi")
    out = incremental.upsert_latest(base, d, ["md5"], [F.col("doc_id").desc()])
    return out.select("md5", "filename", "category")


@query("unsupported_register", rf"""WITH {WEB}
SELECT path, regexp_extract(path, '[^/.](\.[^./]+)$', 1) AS ext, 'unsupported' AS status,
  regexp_replace(path, '/?[^/]*$', '') AS category
FROM web WHERE regexp_extract(path, '[^/.](\.[^./]+)$', 1) NOT IN ('.html')""")
def unsupported_register(spark, sf):
    web = S.web_pages(spark, sf).select("path", P.suffix("path").alias("ext"), P.dirname("path").alias("category"))
    return incremental.register_unsupported(web.filter(F.col("ext") != ".html"))


# ---- links ----------------------------------------------------------------------------

@query("link_extract", f"WITH {PAGES} SELECT src, CAST(pos AS INTEGER) AS pos, target_raw, target FROM links")
def link_extract(spark, sf):
    return links.extract_links(S.linked_pages(spark, sf))


@query("broken_links", f"""WITH {PAGES}, dead AS (SELECT * FROM links WHERE target NOT IN (SELECT note_name FROM pages0))
SELECT src AS note_name, count(*) AS n_broken,
  array_to_string(list_slice(list_sort(list(DISTINCT target)), 1, 5), ',') AS targets FROM dead GROUP BY 1""")
def broken_links(spark, sf):
    p = S.linked_pages(spark, sf)
    return links.broken_links(p, links.extract_links(p), shown=5).withColumn("targets", joined("targets"))


@query("broken_links_full", f"""WITH {PAGES}, dead AS (SELECT * FROM links WHERE target NOT IN (SELECT note_name FROM pages0))
SELECT src AS note_name, count(*) AS n_broken, array_to_string(list_sort(list(DISTINCT target)), ',') AS targets FROM dead GROUP BY 1""")
def broken_links_full(spark, sf):
    """All broken targets of a page."""
    p = S.linked_pages(spark, sf)
    return links.broken_links(p, links.extract_links(p)).withColumn("targets", joined("targets"))


@query("orphans", f"""WITH {PAGES}, c AS (SELECT target, count(*) AS n FROM links GROUP BY 1)
SELECT note_name, coalesce(n, 0) AS n_in FROM pages0 LEFT JOIN c ON target = note_name WHERE coalesce(n, 0) <= 1""")
def orphans(spark, sf):
    p = S.linked_pages(spark, sf)
    return links.orphans(p, links.extract_links(p))


@query("no_outlinks", f"WITH {PAGES} SELECT note_name FROM pages0 WHERE note_name NOT IN (SELECT src FROM links)")
def no_outlinks(spark, sf):
    p = S.linked_pages(spark, sf)
    return links.no_outlinks(p, links.extract_links(p))


LINT = f"""{PAGES}, c AS (SELECT target, count(*) AS n FROM links GROUP BY 1),
dead AS (SELECT * FROM links WHERE target NOT IN (SELECT note_name FROM pages0)),
lint AS (
  SELECT 'orphan' AS type, 'warning' AS severity, note_name, coalesce(n, 0) AS n, '' AS related
  FROM pages0 LEFT JOIN c ON target = note_name WHERE coalesce(n, 0) <= 1
  UNION ALL SELECT 'broken-link', 'warning', src, count(*), array_to_string(list_slice(list_sort(list(DISTINCT target)), 1, 5), ',')
  FROM dead GROUP BY src
  UNION ALL SELECT 'no-outlinks', 'info', note_name, 0, '' FROM pages0 WHERE note_name NOT IN (SELECT src FROM links))"""


@query("lint_report", f"WITH {LINT} SELECT * FROM lint")
def lint_report(spark, sf):
    return links.lint(S.linked_pages(spark, sf), shown=5).withColumn("related", joined("related"))


PATHS = """pp AS (SELECT doc_id, lang || '/' || source || '/n' || doc_id // 5 AS page, 'n' || doc_id // 5 AS stem,
  CASE WHEN doc_id % 3 = 0 THEN ['n' || doc_id // 7, lang || '/' || source || '/n' || doc_id // 5 + 1]
       WHEN doc_id % 3 = 1 THEN ['gone' || doc_id] ELSE [] END AS l FROM documents),
names AS (SELECT page AS target, page AS to_page FROM pp UNION
  SELECT stem, max(page) FROM pp WHERE stem NOT IN (SELECT page FROM pp) GROUP BY stem),
pl AS (SELECT page AS src, unnest(l) AS target FROM pp),
res AS (SELECT src, target, to_page FROM pl LEFT JOIN names USING (target)),
ni AS (SELECT page, count(to_page) AS n FROM (SELECT DISTINCT page FROM pp) LEFT JOIN res ON to_page = page GROUP BY page)"""


@query("lint_paths", f"""WITH {PATHS} SELECT 'orphan' AS type, page AS note_name, n, '' AS related FROM ni WHERE n <= 1
UNION ALL SELECT 'broken-link', src, count(*), array_to_string(list_sort(list(DISTINCT target)), ',') FROM res WHERE to_page IS NULL GROUP BY src
UNION ALL SELECT 'no-outlinks', page, 0, '' FROM (SELECT DISTINCT page FROM pp) WHERE page NOT IN (SELECT src FROM pl)""")
def lint_paths(spark, sf):
    """Pages of five documents, links by path and by stem; folders share stems."""
    d = S.table(spark, sf, "documents")
    num = lambda c: c.cast("bigint").cast("string")
    folder = F.concat_ws("/", "lang", "source")
    five = F.floor(F.col("doc_id") / 5)
    link = lambda c: F.concat(F.lit("[["), c, F.lit("]]"))
    text = F.when(F.col("doc_id") % 3 == 0, F.concat(
        link(F.concat(F.lit("n"), num(F.floor(F.col("doc_id") / 7)))), link(F.concat(folder, F.lit("/n"), num(five + 1))))
    ).when(F.col("doc_id") % 3 == 1, link(F.concat(F.lit("gone"), num(F.col("doc_id"))))).otherwise("")
    rows = d.select(F.concat(folder, F.lit("/n"), num(five), F.lit(".md")).alias("path"), F.concat(F.lit("n"), num(five)).alias("note_name"), text.alias("t"))
    pages = rows.groupBy("path", "note_name").agg(F.array_join(F.collect_list("t"), " ").alias("content"))
    out = links.lint(pages, match_on="either", shown=None)
    return out.select("type", "note_name", "n", joined("related").alias("related"))


@query("lint_summary", f"""WITH {LINT} SELECT type, severity, total, CAST(rank AS INTEGER) AS rank, note_name, n FROM (
  SELECT type, severity, count(*) OVER (PARTITION BY type) AS total,
    row_number() OVER (PARTITION BY type ORDER BY note_name) AS rank, note_name, n FROM lint) WHERE rank <= 10""")
def lint_summary(spark, sf):
    return links.lint_summary(links.lint(S.linked_pages(spark, sf)), 10)


@query("lint_summary_full", f"""WITH {LINT} SELECT type, severity, count(*) OVER (PARTITION BY type) AS total,
  CAST(row_number() OVER (PARTITION BY type ORDER BY note_name) AS INTEGER) AS rank, note_name, n FROM lint""")
def lint_summary_full(spark, sf):
    """Every finding, none cut."""
    out = links.lint_summary(links.lint(S.linked_pages(spark, sf)))
    return out.withColumn("rank", F.col("rank").cast("int"))


def renames(spark, sf):
    """Documents with the same text go to the name of the first one."""
    h = hashed(spark, sf).withColumn("note_name", F.concat(F.lit("d"), "doc_id"))
    first = h.groupBy("md5").agg(F.min_by("note_name", "doc_id").alias("new"), F.min("doc_id").alias("first_id"))
    return h.join(first, "md5").filter("doc_id <> first_id").select(F.col("note_name").alias("old"), "new")


RENAMES = """ren AS (SELECT 'd' || doc_id AS old, 'd' || first_id AS new FROM (
  SELECT doc_id, min(doc_id) OVER (PARTITION BY md5(text)) AS first_id FROM documents) WHERE doc_id <> first_id)"""


@query("link_rewrite", f"""WITH {PAGES}, {RENAMES},
m AS (SELECT map_from_entries(list((old, new))) AS m FROM ren),
w AS (SELECT note_name, content, array_to_string(list_transform(string_split(content, '[['), lambda p, i:
    CASE WHEN i = 1 OR m[regexp_extract(p, '^([^|\\]]+)', 1)] IS NULL THEN p
         ELSE m[regexp_extract(p, '^([^|\\]]+)', 1)] || regexp_replace(p, '^[^|\\]]+', '') END), '[[') AS new FROM pages0, m)
SELECT note_name, md5(new) AS content_md5, new <> content AS changed FROM w""")
def link_rewrite(spark, sf):
    out = links.rewrite_links(S.linked_pages(spark, sf), renames(spark, sf))
    return out.select("note_name", F.md5(F.col("content").cast("binary")).alias("content_md5"), "changed")


@query("link_cleanup", f"""WITH {PAGES}, {RENAMES},
m AS (SELECT list(old) AS gone FROM ren),
w AS (SELECT note_name, content, array_to_string(list_transform(string_split(content, '[['), lambda p, i:
    CASE WHEN i = 1 THEN p WHEN list_contains(gone, regexp_extract(p, '^([^|\\]]+)', 1))
         THEN regexp_replace(p, '^[^\\]]+\\]\\]', '') ELSE '[[' || p END), '') AS new FROM pages0, m),
q AS (SELECT note_name, content, regexp_replace(new, '\\n{{3,}}', chr(10) || chr(10), 'g') AS new FROM w)
SELECT note_name, md5(new) AS content_md5, new <> content AS changed FROM q""")
def link_cleanup(spark, sf):
    gone = renames(spark, sf).select(F.col("old").alias("note_name"))
    out = links.remove_links(S.linked_pages(spark, sf), gone)
    return out.select("note_name", F.md5(F.col("content").cast("binary")).alias("content_md5"), "changed")


# ---- cascade ----------------------------------------------------------------------------

def sourced_pages(spark, sf):
    """Pages whose front matter names one or two sources."""
    d = S.spread(S.table(spark, sf, "documents"))
    many = F.when(F.col("n_chars") >= 1000, F.concat_ws(", ", "source", "lang")).otherwise(F.col("source"))
    return d.select(
        F.concat(F.lit("d"), "doc_id").alias("note_name"), F.concat_ws("/", "lang", "source").alias("path"),
        F.concat(F.lit("---\nsources: ["), many, F.lit("]\n---\n"), "text").alias("content"))


def deleted_sources(spark, sf):
    d, lab = S.table(spark, sf, "documents"), S.table(spark, sf, "labels")
    return d.join(lab.filter("toxic = 1"), "doc_id", "left_semi").select("source").distinct()


CASCADE = """src AS (SELECT 'd' || doc_id AS note_name, 0 AS pos, source FROM documents
  UNION ALL SELECT 'd' || doc_id, 1, lang FROM documents WHERE n_chars >= 1000),
del AS (SELECT DISTINCT source FROM documents JOIN labels USING (doc_id) WHERE toxic = 1),
plan AS (SELECT note_name, CASE WHEN count(*) FILTER (del.source IS NULL) = 0 THEN 'delete' ELSE 'update' END AS action,
  coalesce(string_agg(src.source, ',' ORDER BY pos) FILTER (del.source IS NULL), '') AS remaining
  FROM src LEFT JOIN del USING (source) GROUP BY note_name HAVING count(del.source) > 0)"""


@query("cascade_plan", f"WITH {CASCADE} SELECT * FROM plan")
def cascade_plan(spark, sf):
    plan = cascade.cascade_plan(cascade.page_sources(sourced_pages(spark, sf)), deleted_sources(spark, sf))
    return plan.withColumn("remaining", joined("remaining"))


@query("cascade_delete", f"""WITH {CASCADE}, c AS (
  SELECT 'd' || doc_id AS note_name, '---' || chr(10) || 'sources: [' AS a,
    CASE WHEN n_chars >= 1000 THEN source || ', ' || lang ELSE source END AS l, ']' || chr(10) || '---' || chr(10) || text AS z
  FROM documents),
w AS (SELECT note_name, a || l || z AS old, a || CASE WHEN action IS NULL THEN l
    ELSE '''' || replace(remaining, ',', ''', ''') || '''' END || z AS new
  FROM c LEFT JOIN plan USING (note_name) WHERE action IS DISTINCT FROM 'delete'),
q AS (SELECT note_name, old, new, regexp_replace(new, '\\n{{3,}}', chr(10) || chr(10), 'g') AS fin FROM w)
SELECT note_name, md5(fin) AS content_md5, fin <> new AS changed FROM q""")
def cascade_delete(spark, sf):
    _, pages = cascade.cascade_delete(sourced_pages(spark, sf), deleted_sources(spark, sf))
    return pages.select("note_name", F.md5(F.col("content").cast("binary")).alias("content_md5"), "changed")


# ---- index pages -------------------------------------------------------------------------

def moc_rows(spark, sf):
    n = S.notes(spark, sf)
    return n.select("category", F.col("note_name").alias("stem"), "tags", "rel_path")


def web_rows(spark, sf):
    """Pages as files: folder tree of the URL, one row per page."""
    w = S.web_pages(spark, sf)
    return w.select(
        P.dirname("page_path").alias("category"), P.safe_name("path").alias("stem"), P.suffix("path").alias("ext"),
        F.col("page_path").alias("rel_path"))


@query("moc_entries", """WITH p AS (SELECT 'd' || doc_id AS stem, CASE WHEN toxic = 1 THEN '_failed/' ELSE '' END || lang || '/' || source AS category,
  CASE WHEN quality = 0 THEN 'child' WHEN quality = 1 THEN 'index' ELSE 'page' END AS kind, n_chars
  FROM documents LEFT JOIN labels USING (doc_id))
SELECT stem, category, CASE WHEN n_chars >= 1000 THEN 'long' ELSE 'short' END AS tags FROM p
WHERE NOT starts_with(category, '_failed') AND kind <> 'child' AND n_chars >= 200""")
def moc_entries(spark, sf):
    """Toxic documents lie in the failed folder, low quality ones are child
    pages, high quality ones index pages, tiny ones carry the unsupported tag."""
    d = S.table(spark, sf, "documents").join(S.table(spark, sf, "labels"), "doc_id", "left")
    c = F.lit
    kind = F.when(F.col("quality") == 0, "\nparent: x").when(F.col("quality") == 1, "\nparent: x\ndoc_type: index").otherwise("")
    tag = F.when(F.col("n_chars") >= 1000, "long").when(F.col("n_chars") >= 200, "short").otherwise("未识别格式")
    pages = d.select(
        F.concat_ws("/", F.when(F.col("toxic") == 1, "_failed"), "lang", "source", F.concat(c("d"), "doc_id", c(".md"))).alias("rel_path"),
        F.concat(c("---\ntags: ["), tag, c("]"), kind, c("\n---\n")).alias("content"))
    return moc.entries(pages).select("stem", "category", joined("tags").alias("tags"))


@query("subtree_counts", f"""WITH {WEB}, f AS (SELECT string_split(regexp_replace(page_path, '/?[^/]*$', ''), '/') AS p FROM web),
x AS (SELECT array_to_string(list_slice(p, 1, i), '/') AS prefix, i AS depth FROM (SELECT p, unnest(range(1, len(p) + 1)) AS i FROM f))
SELECT prefix, CAST(depth AS INTEGER) AS depth, count(*) AS n FROM x GROUP BY ALL""")
def subtree_counts(spark, sf):
    return moc.subtree_counts(web_rows(spark, sf))


@query("category_counts", "SELECT lang || '/' || source AS category, count(*) AS n FROM documents GROUP BY 1")
def category_counts(spark, sf):
    return moc.category_counts(S.notes(spark, sf))


@query("moc_parts", f"""WITH r AS (SELECT row_number() OVER (ORDER BY replace(lang || '/' || source || '/d' || doc_id || '.md', '/', chr(1))) AS rn,
  count(*) OVER () AS total FROM documents),
p AS (SELECT CAST(ceil(rn / 500.0) AS INTEGER) AS part, CAST(ceil(total / 500.0) AS INTEGER) AS parts FROM r)
SELECT CASE WHEN parts = 1 THEN 'MOC.md' ELSE 'MOC_' || part || '.md' END AS file, part, count(*) AS n FROM p GROUP BY ALL""")
def moc_parts(spark, sf):
    return moc.part_files(moc_rows(spark, sf))


def lines_sql(rows, title, extra, link, foot, unit, tail=""):
    """SQL of the paged index lines over ``rows`` (category, stem, link, rel_path)."""
    return f"""{rows},
r AS (SELECT *, CAST(ceil(rn / 500.0) AS INTEGER) AS part, CAST(ceil(total / 500.0) AS INTEGER) AS parts FROM (
  SELECT category, {link} AS link, row_number() OVER (ORDER BY replace(rel_path, '/', chr(1))) AS rn,
         count(*) OVER () AS total FROM f)),
one AS (SELECT part, max(parts) AS parts, max(total) AS total FROM r GROUP BY part),
pre AS (SELECT part, string_split(category, '/') AS p FROM r WHERE category <> ''),
h AS (SELECT part, list_slice(p, 1, i) AS p, count(*) AS n FROM (
  SELECT part, p, unnest(range(1, least(len(p), 5) + 1)) AS i FROM pre) GROUP BY ALL),
x AS (
  SELECT part, '00' AS k, 0 AS rn, '{title}' || chr(10) AS line FROM one
  UNION ALL SELECT part, '01', 0, '> 自动更新于 2024-01-01 00:00:00' || chr(10) FROM one
  UNION ALL SELECT part, '02', 0, chr(10) || '> 第 ' || part || '/' || parts || ' 部分 | 总计 ' || total || ' {unit}' || chr(10)
    FROM one WHERE parts > 1
  {extra}
  UNION ALL SELECT part, '1', 0, chr(10) || '## 根目录 (' || count(*) || ' 篇)' || chr(10) FROM r WHERE category = '' GROUP BY part
  UNION ALL SELECT part, '2' || array_to_string(p, chr(1)), 0,
    chr(10) || repeat('#', len(p) + 1) || ' ' || p[-1] || ' (' || n || ' 篇)' || chr(10) FROM h
  UNION ALL SELECT part, CASE WHEN category = '' THEN '1' ELSE '2' || array_to_string(list_slice(string_split(category, '/'), 1, 5), chr(1)) END || chr(1), rn,
    '- [[' || link || chr(10) FROM r
  UNION ALL SELECT part, '3', 0, {foot} FROM one)
SELECT part, CAST(row_number() OVER (PARTITION BY part ORDER BY k, rn) AS INTEGER) AS ord, line FROM x"""


@query("moc_lines", "WITH " + lines_sql(
    NOTES + ", f AS (SELECT *, note_name AS stem FROM notes)", "# 知识树", "",
    """stem || ']]' || CASE WHEN len(tags) > 0 THEN ' ' ELSE '' END
      || array_to_string(list_transform(list_slice(tags, 1, 3), lambda t: '`#' || t || '`'), ', ')
      || CASE WHEN len(tags) > 3 THEN ' 等' || len(tags) || '个' ELSE '' END""",
    "chr(10) || '---' || chr(10) || '**总计：' || total || ' 篇笔记**' || chr(10)", "篇笔记"))
def moc_lines(spark, sf):
    return moc.moc_lines(moc_rows(spark, sf), "2024-01-01 00:00:00")


DEEP = "lang || '/' || source || '/a' || doc_id % 2 || '/b' || doc_id % 3 || '/c' || doc_id % 5 || '/d' || doc_id % 7"


@query("moc_deep", "WITH " + lines_sql(
    f"f AS (SELECT {DEEP} AS category, 'd' || doc_id AS stem, {DEEP} || '/d' || doc_id || '.md' AS rel_path FROM documents)", "# 知识树", "",
    "stem || ']]'", "chr(10) || '---' || chr(10) || '**总计：' || total || ' 篇笔记**' || chr(10)", "篇笔记"))
def moc_deep(spark, sf):
    """A tree of six levels: the deepest notes stand under the fifth."""
    d = S.table(spark, sf, "documents")
    part = lambda name, n: F.concat(F.lit(name), (F.col("doc_id") % n).cast("string"))
    category = F.concat_ws("/", "lang", "source", part("a", 2), part("b", 3), part("c", 5), part("d", 7))
    stem = F.concat(F.lit("d"), F.col("doc_id").cast("string"))
    rows = d.select(category.alias("category"), stem.alias("stem"), F.array().cast("array<string>").alias("tags"),
                    F.concat(category, F.lit("/"), stem, F.lit(".md")).alias("rel_path"))
    return moc.moc_lines(rows, "2024-01-01 00:00:00")


@query("unsupported_moc", "WITH " + lines_sql(
    WEB + r""", f AS (SELECT regexp_replace(page_path, '/?[^/]*$', '') AS category, page_path AS rel_path,
      regexp_extract(path, '[^/.](\.[^./]+)$', 1) AS ext,
      replace(regexp_replace(regexp_extract(path, '[^/]*$'), '([^.])\.[^.]+$', '\1'), ' ', '_') AS stem FROM web)""",
    "# 不支持格式文件",
    "UNION ALL SELECT part, '03', 0, chr(10) || '共 ' || total || ' 个文件格式不支持。' || chr(10) FROM one",
    "stem || ext || ']]'", "chr(10) || '> 自动生成于 2024-01-01 00:00:00' || chr(10)", "个文件"))
def unsupported_moc(spark, sf):
    return moc.unsupported_lines(web_rows(spark, sf), "2024-01-01 00:00:00")


@query("failed_moc", """WITH f AS (SELECT 'FAIL_d' || doc_id AS stem, 'd' || doc_id || '.md' AS source, string_split(text, chr(10))[1] AS reason
  FROM documents JOIN labels USING (doc_id) WHERE toxic = 1),
x AS (SELECT row_number() OVER (ORDER BY stem) AS ord, '- [[' || stem || ']] ' || source || chr(10)
    || CASE WHEN trim(reason) = '' THEN '' ELSE '  - 原因: ' || substr(trim(reason), 1, 80)
    || CASE WHEN length(trim(reason)) > 80 THEN '...' ELSE '' END || chr(10) END AS line FROM f)
SELECT ord, line FROM x
UNION ALL SELECT 0, '# 失败文件' || chr(10) || '> 自动更新于 2024-01-01' || chr(10) || chr(10) || '共 ' || count(*) || ' 个文件处理失败。' || chr(10) || chr(10)
  FROM x HAVING count(*) > 0
UNION ALL SELECT count(*) + 1, chr(10) || '> 自动生成于 2024-01-01' || chr(10) FROM x HAVING count(*) > 0""")
def failed_moc(spark, sf):
    """Toxic documents as failed imports; the first line is the reason, its first 80 characters are shown."""
    return moc.failed_lines(moc.failed_entries(failed_pages(spark, sf)), "2024-01-01", 80)


FAILED_FULL = """WITH f AS (SELECT 'FAIL_d' || doc_id AS stem, 'd' || doc_id || '.md' AS source, trim(string_split(text, chr(10))[1]) AS reason
  FROM documents JOIN labels USING (doc_id) WHERE toxic = 1)
SELECT row_number() OVER (ORDER BY stem) AS ord, '- [[' || stem || ']] ' || source || chr(10)
  || CASE WHEN reason = '' THEN '' ELSE '  - 原因: ' || reason || chr(10) END AS line FROM f"""


@query("failed_moc_full", FAILED_FULL)
def failed_moc_full(spark, sf):
    """Whole reasons; the entries only."""
    lines = moc.failed_lines(moc.failed_entries(failed_pages(spark, sf)), "2024-01-01")
    return lines.filter(F.startswith("line", F.lit("- [[")))


def failed_pages(spark, sf):
    d = S.table(spark, sf, "documents").join(S.table(spark, sf, "labels").filter("toxic = 1"), "doc_id", "left_semi")
    name = F.concat(F.lit("d"), F.col("doc_id").cast("string"))
    page = d.select(
        F.concat(F.lit("_failed/FAIL_"), name, F.lit(".md")).alias("rel_path"),
        F.concat(F.lit("---\nsource: "), name, F.lit(".md\n---\n- **原因**: "), F.substring_index("text", "\n", 1), F.lit("\n")).alias("content"))
    return page


@query("moc_stale_files", """WITH old AS (SELECT DISTINCT 'MOC_' || CAST(ceil(doc_id / 100.0) AS INTEGER) || '.md' AS file FROM documents),
r AS (SELECT CAST(ceil(row_number() OVER (ORDER BY doc_id) / 500.0) AS INTEGER) AS part, count(*) OVER () AS total FROM documents),
cur AS (SELECT DISTINCT CASE WHEN total <= 500 THEN 'MOC.md' ELSE 'MOC_' || part || '.md' END AS file FROM r)
SELECT file FROM old WHERE file NOT IN (SELECT file FROM cur)""")
def moc_stale_files(spark, sf):
    d = S.table(spark, sf, "documents")
    old = d.select(F.concat(F.lit("MOC_"), F.ceil(F.col("doc_id") / 100).cast("string"), F.lit(".md")).alias("file")).distinct()
    return moc.stale_files(old, moc.part_files(moc_rows(spark, sf)))
