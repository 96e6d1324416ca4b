"""Front matter and Markdown columns (no UDFs)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K
from .paths import _col, stem, strip
from .text import joined, nonblank

C = F.lit


def quoted(value) -> Column:
    """A value made safe as the replacement text of ``regexp_replace``."""
    v = F.replace(_col(value), C("\\"), C("\\\\"))
    return F.replace(v, C("$"), C("\\$"))


def replace_first(text, old: str, new: Column) -> Column:
    t = _col(text)
    at = F.instr(t, C(old)) if not isinstance(old, str) else F.instr(t, old)
    return F.when(
        at > 0, F.concat(F.substr(t, C(1), at - 1), new, F.substr(t, at + len(old)))
    ).otherwise(t)


# ---- front matter --------------------------------------------------------------

def front_block(content) -> Column:
    """Text between the leading ``---`` lines, '' without front matter."""
    return F.regexp_extract(_col(content), r"\A---\n([\s\S]*?)\n---\n?", 1)


def _unquote(c: Column) -> Column:
    return F.btrim(strip(c), C("'\""))


def _list_items(value: Column) -> Column:
    inner = strip(F.substr(value, C(2), F.length(value) - 2))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(
        F.transform(F.split(inner, ","), _unquote)
    )


def parse_front_matter(content) -> Column:
    """``struct<fields: map<string,string>, lists: map<string,array<string>>>``.

    The first ``:`` of a line splits it, ``[a, b]`` values become lists, and
    of repeated keys the last wins.
    """
    lines = F.filter(F.split(front_block(content), "\n"), lambda s: F.contains(s, C(":")))
    pairs = F.transform(
        lines,
        lambda s: F.struct(
            strip(F.substring_index(s, ":", 1)).alias("key"),
            strip(F.substr(s, F.instr(s, ":") + 1)).alias("value"),
        ),
    )
    keys = F.reverse(F.transform(pairs, lambda e: e["key"]))
    last = F.filter(
        pairs, lambda e, i: F.array_position(keys, e["key"]) == F.size(keys) - i
    )
    is_list = lambda e: F.startswith(e["value"], C("[")) & F.endswith(e["value"], C("]"))
    return F.struct(
        F.map_from_entries(F.transform(
            F.filter(last, lambda e: ~is_list(e)),
            lambda e: F.struct(e["key"], F.btrim(e["value"], C("'\""))),
        )).alias("fields"),
        F.map_from_entries(F.transform(
            F.filter(last, is_list), lambda e: F.struct(e["key"], _list_items(e["value"]))
        )).alias("lists"),
    )


def front_field(content, name: str) -> Column:
    """One field of the front matter by name, '' when absent."""
    return strip(F.regexp_extract(
        front_block(content), rf"(?md){name}:\s*[\"']?(.+?)[\"']?\s*$", 1
    ))


def front_list(content, name: str) -> Column:
    """One bracketed list of the front matter, [] when absent."""
    inner = F.regexp_extract(front_block(content), rf"{name}:\s*\[([^\]]*)\]", 1)
    return F.filter(F.transform(F.split(inner, ","), _unquote), lambda s: s != "")


def line_value(content, name: str, last: bool = False) -> Column:
    """Value of the first (or last) line that starts with ``name:``."""
    hits = F.filter(F.split(_col(content), "\n"), lambda s: F.startswith(s, C(name + ":")))
    hit = F.try_element_at(hits, C(-1 if last else 1))
    return F.coalesce(strip(F.substr(hit, C(len(name) + 2))), C(""))


def line_list(content, name: str, last: bool = False) -> Column:
    raw = F.btrim(line_value(content, name, last), C("[]"))
    return F.filter(F.transform(F.split(raw, ","), lambda s: strip(s)), lambda s: s != "")


def page_title(content, path) -> Column:
    """Front matter title, else the file stem; '' for unreadable pages."""
    return F.coalesce(nonblank(front_field(content, "title")), F.when(_col(content).isNotNull(), stem(path)), C(""))


def fill_empty_tags(content, tags, limit: int = 20) -> Column:
    """Put the tags into the first empty ``tags: []``."""
    t = _col(tags)
    line = F.concat(C("tags: ["), F.array_join(F.slice(t, 1, limit), ", "), C("]"))
    return F.when(F.size(t) > 0, replace_first(content, "tags: []", line)).otherwise(_col(content))


def rewrite_list(content, name: str, values, quote: str) -> Column:
    """Set every ``name: [...]`` of a page to the given values."""
    items = F.array_join(F.transform(_col(values), lambda v: F.concat(C(quote), v, C(quote))), ", ")
    return F.regexp_replace(
        _col(content), C(rf"(?s){name}:\s*\[(.*?)\]"), quoted(F.concat(C(f"{name}: ["), items, C("]")))
    )


# ---- body --------------------------------------------------------------------------

def clean_markdown(content) -> Column:
    """Markdown to plain text: ordered passes, then trim."""
    out = _col(content)
    for pattern, repl in K.MARKDOWN_PASSES:
        out = F.regexp_replace(out, pattern, repl)
    return strip(out)


def split_sections(content, ignore_fenced: bool = False, default: str = K.PREAMBLE_TITLE) -> Column:
    """``array<struct<level,title,text>>`` of a page, cut at headings.

    Text before the first heading gets the default title, sections without
    text are dropped, and a page without any keeps its whole text as one.
    """
    c = _col(content)
    if ignore_fenced:
        c = F.regexp_replace(c, r"```[\s\S]*?```", "")
    heading = r"(?md)\A(#{1,6})\s+(.+)$"
    parts = F.filter(F.split(c, r"(?md)(?=^#{1,6}\s+.+$)"), lambda s: s != "")
    rows = F.transform(
        parts,
        lambda s: F.struct(
            F.length(F.regexp_extract(s, heading, 1)).alias("level"),
            F.coalesce(nonblank(strip(F.regexp_extract(s, heading, 2))), C(default)).alias("title"),
            clean_markdown(F.regexp_replace(s, heading, "")).alias("text"),
        ),
    )
    rows = F.filter(rows, lambda r: r["text"] != "")
    one = lambda w: F.array(F.struct(C(0).alias("level"), C(default).alias("title"), w.alias("text")))
    whole = once(clean_markdown(content), lambda w: F.when(w != "", one(w)).otherwise(F.slice(one(w), 1, 0)))
    return once(rows, lambda r: F.when(F.size(r) > 0, r).otherwise(whole))


def once(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), use), C(0))


def image_refs(content) -> Column:
    """Targets of Markdown images that are not web or data links."""
    refs = F.regexp_extract_all(_col(content), C(K.MARKDOWN_IMAGE), C(1))
    return F.filter(refs, lambda r: ~r.rlike("^(http://|https://|data:)"))


def wikilinks(content, pattern: str = K.WIKILINK) -> Column:
    """Targets of all page links, in order, with repeats."""
    return F.regexp_extract_all(_col(content), C(pattern), C(1))


def related_block(targets, heading: str = K.RELATED_HEADING) -> Column:
    lines = F.transform(_col(targets), lambda t: F.concat(C("- [["), t, C("]]\n")))
    return F.concat(C(f"\n{heading}\n"), F.array_join(lines, ""))


def put_related(content, targets, heading: str = K.RELATED_HEADING, footer: str = K.FOOTER_PREFIX,
                keep_footer: bool = False) -> Column:
    """Replace the related-pages section, else insert it before the footer,
    else append it.

    A section that is replaced reaches to the next heading or the end of the
    page, which takes a footer below it along; ``keep_footer`` stops there.
    """
    c = _col(content)
    block = related_block(targets, heading)
    foot = "\n" + footer
    stop = rf"\n##|{foot}|\z" if keep_footer else r"\n##|\z"
    section = rf"\n{heading}\n[\s\S]*?(?={stop})"
    return (
        F.when(F.size(_col(targets)) == 0, c)
        .when(c.rlike(section), F.regexp_replace(c, C(section), quoted(block)))
        .when(F.contains(c, C(foot)), F.replace(c, C(foot), F.concat(block, C(foot))))
        .otherwise(F.concat(F.rtrim(c, C(K.WHITESPACE)), block, C("\n")))
    )


def migrate_references(content, path) -> Column:
    """Bring three older shapes of the source reference block to link form."""
    c, page = _col(content), stem(path)
    head = f"\n{K.ARCHIVE_HEADING}\n- {K.ORIGINAL_LABEL}：[["
    # shape with file name and path under the old heading: links the page stem
    old = r"\n## 原文位置\n- 原文：`[^`]+`\n- 路径：`[^`]+`\n"
    moved = F.regexp_replace(c, old, head + "{}]]\n\n")
    other = F.regexp_extract(moved, "原文：`([^`]+)`", 1)
    target = F.when(other != "", stem(other)).otherwise(page)
    c = F.when(c.rlike(old), replace_first(moved, "[[{}]]", F.concat(C("[["), target, C("]]")))).otherwise(c)
    for old in (
        r"\n## 原始文件\n- 文件名：`[^`]+`\n- 源路径：`[^`]+`\n\n",
        r"\n## 原始文件\n- 文件名：`[^`]+`\n\n",
    ):
        name = stem(F.regexp_extract(c, "文件名：`([^`]+)`", 1))
        c = F.regexp_replace(c, C(old), quoted(F.concat(C(head), name, C("]]\n\n"))))
    return c


# ---- rendering -------------------------------------------------------------------------

def _front(*lines: Column) -> Column:
    return F.concat(C("---\n"), joined(*lines), C("\n---\n"))


def _kv(key: str, value: Column) -> Column:
    return F.concat(C(key + ": "), value)


def _tag_list(tags) -> Column:
    return F.concat(C("tags: ["), F.array_join(_col(tags), ", "), C("]"))


def render_page(
    source, date, category, tags, original_path, summary, outline, made_at,
    footer: str = K.FOOTER_PREFIX,
) -> Column:
    """The Markdown text of a note; empty parts are left out."""
    link = F.concat(
        C(f"- {K.ORIGINAL_LABEL}：[["), F.regexp_replace(
            F.coalesce(_col(original_path), _col(source)), r"\.[^.]*$", ""), C("]]\n\n"))
    shown = F.array_join(F.transform(_col(tags), lambda t: F.concat(C("`#"), t, C("`"))), ", ")
    some = nonblank(summary)
    return joined(
        _front(
            _kv("source", _col(source)), _kv("date", _col(date)), _kv("category", _col(category)),
            _tag_list(tags), _kv("original_path", _col(original_path)),
        ),
        F.concat(C("# "), stem(source), C("\n")),
        F.when(some.isNotNull(), C(K.SUMMARY_HEADING + "\n")),
        F.concat(some, C("\n")),
        C(K.OUTLINE_HEADING + "\n"),
        F.concat(F.array_join(_col(outline), "\n"), C("\n")),
        C(K.ARCHIVE_HEADING + "\n"),
        link,
        F.when(F.size(_col(tags)) > 0, C(K.TAGS_HEADING + "\n")),
        F.when(F.size(_col(tags)) > 0, F.concat(shown, C("\n"))),
        F.concat(C("\n" + footer), _col(made_at), C("\n")),
    )


def leaf(name) -> Column:
    return F.substring_index(_col(name), "/", -1)


def render_index(source, date, category, tags, links, summary, original_path, made_at,
                 footer: str = K.FOOTER_PREFIX) -> Column:
    """Index page of a long document; ``links`` is array<struct<link,title>>."""
    l = _col(links)
    some = nonblank(summary)
    items = F.transform(l, lambda x: F.concat(
        C("- [["), x["link"], C("|"), leaf(x["link"]), C("]] "), x["title"], C("\n")))
    return joined(
        _front(
            _kv("source", _col(source)), _kv("date", _col(date)), _kv("category", _col(category)),
            _tag_list(tags), C("doc_type: index"), _kv("sections", F.size(l).cast("string")),
            _kv("original_path", _col(original_path)),
        ),
        F.concat(C("# "), stem(source), C("\n")),
        F.when(some.isNotNull(), C(K.INDEX_SUMMARY_HEADING + "\n")),
        F.concat(some, C("\n\n")),
        C(K.CONTENTS_HEADING + "\n"),
        F.when(F.size(l) > 0, F.array_join(items, "\n")),
        F.concat(C("\n---\n" + footer), _col(made_at), C("\n")),
    )


def render_child(source, date, category, tags, parent, original_path, title, summary, text, images, made_at,
                 footer: str = K.FOOTER_PREFIX) -> Column:
    """Page of one section with a link back to its index page."""
    i, some = _col(images), nonblank(summary)
    return joined(
        _front(
            _kv("source", _col(source)), _kv("date", _col(date)), _kv("category", _col(category)),
            _tag_list(tags), _kv("parent", _col(parent)), _kv("original_path", _col(original_path)),
        ),
        F.concat(C("# "), nonblank(title), C("\n")),
        F.when(some.isNotNull(), C(K.CHILD_SUMMARY_HEADING + "\n")),
        F.concat(some, C("\n\n")),
        F.concat(nonblank(text), C("\n\n")),
        F.when(F.size(i) > 0, C(K.IMAGES_HEADING + "\n")),
        F.when(F.size(i) > 0, F.array_join(F.transform(i, lambda d: F.concat(C("> "), d, C("\n\n"))), "\n")),
        F.concat(C(f"\n> {K.BACK_LABEL} [["), _col(parent), C("|"), leaf(parent), C("]]")),
        F.concat(C("\n" + footer), _col(made_at), C("\n")),
    )


def render_failure(path, error, date) -> Column:
    """Page that records a failed file."""
    values = {"name": F.substring_index(_col(path), "/", -1), "path": _col(path), "error": _col(error), "date": _col(date)}
    parts, rest = [], K.FAILED_PAGE
    while "{" in rest:
        before, _, rest = rest.partition("{")
        name, _, rest = rest.partition("}")
        parts += [C(before), values[name]]
    return F.concat(*parts, C(rest))


def failure_name(path, stamp) -> Column:
    """FAIL_<safe stem>_<stamp>.md in the failed folder."""
    return F.concat(C(f"{K.FAILED_FOLDER}/FAIL_"), F.replace(stem(path), C(" "), C("_")), C("_"), _col(stamp), C(".md"))
