"""Sections, images and model requests of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import markdown as M
from ..functions import text as T
from ..functions.paths import strip
from ..plans.joins import attach

C = F.lit


def sections(pages: DataFrame, name: str = "note_name", ignore_fenced: bool = False) -> DataFrame:
    """name, pos, level, title, text of every section."""
    return pages.select(name, F.posexplode(M.split_sections("content", ignore_fenced)).alias("pos", "s")).select(
        name, "pos", "s.level", "s.title", "s.text")


def ordered_text(pos: str, value: Column, sep: str) -> Column:
    """Aggregate: values joined in order of ``pos``, NULLs left out."""
    rows = F.sort_array(F.collect_list(F.when(value.isNotNull(), F.struct(F.col(pos).alias("p"), value.alias("v")))))
    return F.array_join(F.transform(rows, lambda s: s["v"]), sep)


def batch_sections(rows: DataFrame, doc: str, pos: str, text: str, k: int = K.SECTIONS_PER_CALL,
                   sep: str = "\n\n---\n\n") -> DataFrame:
    """doc, batch, combined, n: every k sections as one text.

    Empty texts are skipped and blank batches dropped. A group is k sections.
    """
    return (
        rows.groupBy(doc, F.floor(F.col(pos) / k).alias("batch"))
        .agg(ordered_text(pos, T.nonblank(text), sep).alias("combined"), F.count("*").alias("n"))
        .filter(strip("combined") != "")
    )


def share_summaries(rows: DataFrame, summaries: DataFrame, doc: str, pos: str, k: int = K.SECTIONS_PER_CALL) -> DataFrame:
    """Each section with the summary of its batch."""
    return rows.withColumn("batch", F.floor(F.col(pos) / k)).join(summaries, [doc, "batch"]).drop("batch")


def overview_parts(rows: DataFrame, doc: str, pos: str, summary: str, per_part: int = 50,
                   max_chars: int | None = None) -> DataFrame:
    """doc, part, text: the section summaries of a document, one per line.

    A long document becomes several parts of ``per_part`` sections, so no text
    is lost and no group grows with the document; ``max_chars`` cuts each part.
    """
    line = F.concat(T.nonblank(summary), C("\n"))
    out = rows.groupBy(doc, F.floor(F.col(pos) / per_part).alias("part")).agg(ordered_text(pos, line, "").alias("text"))
    if max_chars is not None:
        out = out.withColumn("text", F.substring("text", 1, max_chars))
    return out.filter(strip("text") != "")


def outline_parts(rows: DataFrame, doc: str, pos: str, title: str, summary: str, per_part: int = 50,
                  shown: int | None = None, max_chars: int | None = None) -> DataFrame:
    """As overview_parts with lines ``title: summary`` (its first ``shown``
    characters, all by default)."""
    t, s = T.nonblank(title), T.nonblank(F.col(summary) if shown is None else F.substring(summary, 1, shown))
    line = F.when(s.isNotNull(), F.concat(t, C(": "), s)).otherwise(t)
    out = rows.groupBy(doc, F.floor(F.col(pos) / per_part).alias("part")).agg(ordered_text(pos, line, "\n").alias("text"))
    if max_chars is not None:
        out = out.withColumn("text", F.substring("text", 1, max_chars))
    return out.filter(strip("text") != "")


def totals(rows: DataFrame, doc: str, text: str) -> DataFrame:
    """doc, n_sections, n_chars."""
    return rows.groupBy(doc).agg(F.count("*").alias("n_sections"), F.sum(F.length(text)).alias("n_chars"))


# ---- routing ------------------------------------------------------------------------

def has_content(text, n_images, n_sections) -> Column:
    return (strip(text) != "") | (F.col(n_images) > 0) | (F.col(n_sections) > 0)


def should_split(n_chars, n_sections, threshold: int = 3000) -> Column:
    return (F.col(n_sections) >= 3) | (F.col(n_chars) >= threshold)


def strategy(n_chars, n_sections, text_limit: int = 3000, section_limit: int = 3) -> Column:
    long = (F.col(n_sections) >= section_limit) | ((F.col(n_chars) >= text_limit) & (F.col(n_sections) > 0))
    return F.when(long, "long").otherwise("short")


def is_large(n_chars, n_sections, sections_limit: int = 5, chars_limit: int = 10000) -> Column:
    return (F.col(n_sections) >= sections_limit) | (F.col(n_chars) >= chars_limit)


def needs_ocr(text, n_pages, n_images, per_page: int = K.OCR_CHARS_PER_PAGE) -> Column:
    """Images but little text per page: filter on this before recognising."""
    per = F.length(strip(text)) / F.greatest(F.col(n_pages), C(1))
    return (F.col(n_images) > 0) & (per < per_page)


# ---- page runs ------------------------------------------------------------------------

NOISE = [r"^\d+$", r"^\s*$"]


def infer_titles(pages, titles, pattern: str, noise: list[str] = NOISE, low: int = 3, high: int = 30) -> Column:
    """For each page text the first title-like match of its first usable line,
    else its given title.

    Lines that match a ``noise`` pattern or hold no match of ``pattern`` with
    ``low`` to ``high`` characters are passed over.
    """
    def usable(line):
        out = strip(line) != ""
        for n in noise:
            out = out & ~strip(line).rlike(n)
        return out

    def title_of(page):
        found = F.transform(F.filter(F.split(page, "\n"), usable), lambda s: strip(F.regexp_extract(strip(s), pattern, 0)))
        return F.try_element_at(F.filter(found, lambda t: F.length(t).between(low, high)), C(1))

    return F.zip_with(F.col(pages), F.col(titles), lambda p, t: F.coalesce(title_of(p), t))


def merge_runs(docs: DataFrame, doc: str, pages: str, titles: str, sep: str = "\n\n") -> DataFrame:
    """doc, run, title, text, n_pages: consecutive pages of equal title joined.

    pages and titles are arrays of one row per document, so nothing is
    shuffled. Give pages without an inferred title distinct titles (their page
    number) to keep them apart.
    """
    idx = F.sequence(C(1), F.size(titles))
    starts = F.filter(idx, lambda i: (i == 1) | (F.get(F.col(titles), i - 1) != F.get(F.col(titles), i - 2)))
    d = docs.filter(F.size(titles) > 0).withColumn("_starts", starts)
    ends = F.slice(F.concat("_starts", F.array(F.size(titles) + 1)), C(2), F.size("_starts"))
    runs = F.zip_with("_starts", ends, lambda a, b: F.struct(
        F.element_at(titles, a).alias("title"),
        F.array_join(F.slice(pages, a, b - a), sep).alias("text"),
        (b - a).cast("int").alias("n_pages"),
    ))
    return d.select(doc, F.posexplode(runs).alias("run", "r")).select(doc, "run", "r.title", "r.text", "r.n_pages")


# ---- images -------------------------------------------------------------------------------

def describe_images(images: DataFrame, recognised: Column | None = None, limit: int = K.MAX_IMAGES) -> DataFrame:
    """doc, pos, description: given text, else the recogniser's for the first
    ``limit`` images of a document, else ''. images: doc, pos, ocr."""
    given = T.nonblank(strip("ocr"))
    rec = F.when(F.col("pos") < limit, strip(recognised)) if recognised is not None else C(None).cast("string")
    return images.withColumn("description", F.coalesce(given, rec, C("")))


def image_context(images: DataFrame, doc: str, label: str = K.IMAGE_LABEL, limit: int | None = None) -> DataFrame:
    """doc, context: ``[label i] text`` of the images with text, of the first
    ``limit`` of a document only if that is given."""
    text = F.when(F.col("description") != "", F.concat(
        C("[" + label), (F.col("pos") + 1).cast("string"), C("] "), "description"))
    picked = images if limit is None else images.filter(F.col("pos") < limit)
    return picked.groupBy(doc).agg(ordered_text("pos", text, "\n\n").alias("context"))


def with_image_context(texts: DataFrame, context: DataFrame, doc: str, text: str) -> DataFrame:
    block = F.concat(F.col(text), C(f"\n\n{K.IMAGE_CONTEXT_LABEL}\n"), "context")
    return attach(texts, context.filter("context <> ''"), doc).withColumn(
        text, F.coalesce(block, F.col(text))).drop("context")


# ---- model requests ---------------------------------------------------------------------------

def enhanced_context(hint, points, entities, concepts, text) -> Column:
    """Labelled non-empty parts of a structure analysis, then the text."""
    def listed(c, label, sep, pre=""):
        items = F.transform(F.col(c), lambda x: F.concat(C(pre), x))
        return F.when(F.size(c) > 0, F.concat(C(label), F.array_join(items, sep)))

    parts = F.array_compact(F.array(
        F.concat(C(K.OVERVIEW_LABEL), T.nonblank(hint)),
        listed(points, K.POINTS_LABEL + "\n", "\n", "- "),
        listed(entities, K.ENTITIES_LABEL, ", "),
        listed(concepts, K.CONCEPTS_LABEL, ", "),
    ))
    head = F.concat(C(K.ANALYSIS_LABEL + "\n"), F.array_join(parts, "\n\n"), C(f"\n\n{K.ORIGINAL_TEXT_LABEL}\n"), F.col(text))
    return F.when(F.size(parts) > 0, head).otherwise(F.col(text))


def build_requests(docs: DataFrame, doc: str, text: str, kind: str, overflow: str = "split",
                   limits: dict = K.REQUEST_LIMITS) -> DataFrame:
    """doc, kind, part, send, body of the requests for one kind of enrichment.

    Texts below the kind's least length are not sent (``send`` is false; a
    summary is then the text itself). Longer texts than one request may hold
    are split into parts over the whole text, or cut with ``overflow='cut'``.
    """
    least, most = limits[kind]
    t = F.col(text)
    n = F.greatest(F.ceil(F.length(t) / most).cast("int"), C(1)) if overflow == "split" else C(1)
    parts = F.transform(F.sequence(C(0), n - 1), lambda i: F.substr(t, i * most + 1, C(most)))
    send = F.length(t) >= least
    body = F.when(send, parts).otherwise(F.array(strip(t)))
    return docs.select(doc, C(kind).alias("kind"), send.alias("send"), F.posexplode(body).alias("part", "body"))


# ---- responses ----------------------------------------------------------------------------------

STRUCTURE = ("entities array<string>, concepts array<string>, key_points array<string>, "
             "doc_type string, summary_hint string")


def strip_fence(raw) -> Column:
    """Drop a code fence around an answer."""
    r = strip(raw)
    lines = F.split(r, "\n")
    inner = F.slice(lines, C(2), F.size(lines))
    inner = F.when(
        (F.size(inner) > 0) & F.startswith(F.try_element_at(inner, C(-1)), C("```")),
        F.slice(inner, C(1), F.greatest(F.size(inner) - 1, C(0))),
    ).otherwise(inner)
    return F.when(F.startswith(r, C("```")), F.array_join(inner, "\n")).otherwise(r)


def parse_structure(raw, text, short: int = 100, hint: int | None = None) -> Column:
    """struct of a structure answer with defaults for what is missing; answers
    that are not JSON give empty lists and the text (its first ``hint``
    characters) as hint."""
    t = F.col(text) if isinstance(text, str) else text
    p = F.from_json(strip_fence(raw), STRUCTURE)
    good = F.startswith(strip(strip_fence(raw)), C("{")) & F.get_json_object(strip_fence(raw), "$").isNotNull()
    none = F.array().cast("array<string>")
    is_short = F.length(t) < short
    lists = [F.when(~is_short & good, F.coalesce(p[c], none)).otherwise(none).alias(c)
             for c in ("entities", "concepts", "key_points")]
    kind = F.when(is_short, K.SHORT_TEXT_TYPE).when(good, F.coalesce(p["doc_type"], C(K.UNKNOWN_TYPE))).otherwise(K.UNKNOWN_TYPE)
    start = t if hint is None else F.substring(t, 1, hint)
    line = F.when(is_short, start).when(good, F.coalesce(p["summary_hint"], C(""))).otherwise(start)
    return F.struct(*lists, kind.alias("doc_type"), line.alias("summary_hint"))
