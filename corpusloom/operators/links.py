"""Page links: extraction, health checks, rewriting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import markdown as M
from ..functions import paths as P
from ..plans.joins import attach
from ..plans.ranking import group_rank, top_k
from ..session import settle

PIECES = r"(?=\[\[)|(?<=\]\])"
LINK = r"^\[\[([^\]|]+)(\|[^\]]+)?\]\]$"


def extract_links(pages: DataFrame, name: str = "note_name", max_chars: int | None = None) -> DataFrame:
    """src, pos, target_raw, target for each page link, repeats included."""
    text = F.col("content") if max_chars is None else F.substring("content", 1, max_chars)
    return pages.select(F.col(name).alias("src"), F.posexplode(M.wikilinks(text)).alias("pos", "target_raw")).withColumn(
        "target", P.normalize_link("target_raw")
    )


def _page_id(match_on: str) -> Column:
    """What identifies a page: its stem, or its path without extension."""
    return F.col("note_name") if match_on == "stem" else P.without_suffix("path")


def resolve_links(pages: DataFrame, links: DataFrame, match_on: str = "stem") -> DataFrame:
    """links with ``to``: the page a link means, NULL for none.

    match_on: ``stem``, ``path`` (without extension), or ``either``, where a
    path goes before a stem and of pages with one stem the last path counts.
    """
    path = P.without_suffix("path")
    name = {"stem": [(F.col("note_name"), 0)], "path": [(path, 1)], "either": [(path, 1), (F.col("note_name"), 0)]}[match_on]
    told = F.array(*[F.struct(P.normalize_link(n).alias("target"), F.lit(p).alias("first"), _page_id(match_on).alias("to")) for n, p in name])
    names = pages.select(F.explode(told).alias("n")).groupBy("n.target").agg(F.max(F.struct("n.first", "n.to")).alias("n"))
    return links.join(names.select("target", "n.to"), "target", "left").select(*links.columns, "to")


def broken_links(pages: DataFrame, links: DataFrame, match_on: str = "stem", shown: int | None = None) -> DataFrame:
    """note_name, n_broken (repeats count), the first distinct broken targets
    (``shown`` None: all)."""
    return _broken(resolve_links(pages, links.filter("target <> ''"), match_on), shown)


def _broken(resolved: DataFrame, shown: int | None) -> DataFrame:
    targets = F.sort_array(F.collect_set("target"))
    return resolved.filter("to IS NULL AND target <> ''").groupBy(F.col("src").alias("note_name")).agg(
        F.count("*").alias("n_broken"), (targets if shown is None else F.slice(targets, 1, shown)).alias("targets"))


def inlink_counts(pages: DataFrame, links: DataFrame, match_on: str = "stem") -> DataFrame:
    """note_name (the path without extension unless matched on stems), n_in."""
    return _inlinks(pages.select(_page_id(match_on).alias("note_name")), resolve_links(pages, links, match_on))


def _inlinks(ids: DataFrame, resolved: DataFrame) -> DataFrame:
    n = resolved.filter("to IS NOT NULL").groupBy(F.col("to").alias("note_name")).agg(F.count("*").alias("n_in"))
    return ids.join(n, "note_name", "left").fillna(0, ["n_in"])


def _exempt(exempt: str) -> Column:
    return F.startswith(P.basename("note_name"), F.lit(exempt))


def orphans(pages: DataFrame, links: DataFrame, orphan_max: int = 1, exempt: str = "MOC_", match_on: str = "stem") -> DataFrame:
    """Pages with at most ``orphan_max`` links to them; index pages exempt."""
    return inlink_counts(pages, links, match_on).filter((F.col("n_in") <= orphan_max) & ~_exempt(exempt))


def no_outlinks(pages: DataFrame, links: DataFrame, exempt: str = "MOC_") -> DataFrame:
    has = links.filter("target <> ''").select(F.col("src").alias("note_name")).distinct()
    return pages.select("note_name").filter(~_exempt(exempt)).join(has, "note_name", "left_anti")


def lint(pages: DataFrame, match_on: str = "stem", orphan_max: int = 1, max_chars: int | None = None,
         shown: int | None = None) -> DataFrame:
    """type, severity, note_name, n, related of all findings.

    Matched on stems, of pages with the same stem the last path counts, for
    all checks; else every path is a page and note_name its path without
    extension. Texts are scanned once and never shuffled; each link is resolved
    once, and all checks read that table.
    """
    one = pages.groupBy(_page_id(match_on).alias("page")).agg(F.max(F.struct("path", "note_name")).alias("p")).select(
        "page", "p.path", "p.note_name")
    found = extract_links(pages.withColumn("_who", F.struct("path")), "_who", max_chars)
    found = found.select(F.col("src.path").alias("path"), "pos", "target").join(one.select("page", "path"), "path")
    links = settle(resolve_links(one, found.select(F.col("page").alias("src"), "pos", "target"), match_on))
    ids = one.select(F.col("page").alias("note_name"))
    head = lambda kind, sev: [F.lit(kind).alias("type"), F.lit(sev).alias("severity"), "note_name"]
    none = F.array().cast("array<string>").alias("related")
    lonely = _inlinks(ids, links).filter((F.col("n_in") <= orphan_max) & ~_exempt("MOC_"))
    return (
        lonely.select(*head("orphan", "warning"), F.col("n_in").alias("n"), none)
        .unionByName(_broken(links, shown).select(
            *head("broken-link", "warning"), F.col("n_broken").alias("n"), F.col("targets").alias("related")))
        .unionByName(no_outlinks(ids, links).select(
            *head("no-outlinks", "info"), F.lit(0).cast("bigint").alias("n"), none))
    )


def lint_summary(findings: DataFrame, shown: int | None = None) -> DataFrame:
    """Total per type with its first findings (``shown`` None: all)."""
    total = findings.groupBy("type", "severity").agg(F.count("*").alias("total"))
    rows = findings.select("type", "note_name", "n")
    first = group_rank(rows, ["type"], ["note_name"], "rank") if shown is None else top_k(
        rows, ["type"], [F.col("note_name").asc()], shown)
    return first.join(total, "type")


# ---- rewriting -------------------------------------------------------------------

def _pieces(content) -> Column:
    return F.split(F.col(content), PIECES)


def rewrite_links(pages: DataFrame, rename_map: DataFrame) -> DataFrame:
    """Replace ``[[old]]`` / ``[[old|alias]]`` by the new name, keep the alias.

    rename_map: old, new (one row per old). All links change in one pass, so
    a new name is not renamed again. Only link names are shuffled to find the
    pages to change. Adds ``changed``.
    """
    links = extract_links(pages).select("src", F.col("target_raw").alias("old")).distinct()
    per_page = (
        links.join(rename_map.select("old", "new"), "old")
        .groupBy(F.col("src").alias("note_name"))
        .agg(F.map_from_entries(F.collect_list(F.struct("old", "new"))).alias("_map"))
    )
    new = lambda p: F.col("_map")[F.regexp_extract(p, LINK, 1)]
    swap = lambda p: F.when(
        p.rlike(LINK) & new(p).isNotNull(),
        F.concat(F.lit("[["), new(p), F.regexp_extract(p, LINK, 2), F.lit("]]")),
    ).otherwise(p)
    text = F.when(
        F.col("_map").isNotNull(), F.array_join(F.transform(_pieces("content"), swap), "")
    ).otherwise(F.col("content"))
    return _swap_content(attach(pages, per_page, "note_name"), text, pages.columns)


def remove_links(pages: DataFrame, removed: DataFrame, squeeze_all: bool = True) -> DataFrame:
    """Delete links to removed pages and squeeze three or more line breaks.

    removed: note_name. ``squeeze_all`` also squeezes pages without such links.
    Adds ``changed``.
    """
    links = extract_links(pages).select("src", F.col("target_raw").alias("_t")).distinct()
    per_page = (
        links.join(removed.select(F.col("note_name").alias("_t")).distinct(), "_t", "left_semi")
        .groupBy(F.col("src").alias("note_name")).agg(F.collect_list("_t").alias("_dead"))
    )
    cut = lambda p: F.when(
        p.rlike(LINK) & F.array_contains("_dead", F.regexp_extract(p, LINK, 1)), F.lit("")
    ).otherwise(p)
    has = F.col("_dead").isNotNull()
    text = F.when(has, F.array_join(F.transform(_pieces("content"), cut), "")).otherwise(F.col("content"))
    squeezed = F.regexp_replace(text, r"\n{3,}", "\n\n")
    text = squeezed if squeeze_all else F.when(has, squeezed).otherwise(text)
    return _swap_content(attach(pages, per_page, "note_name"), text, pages.columns)


def _swap_content(df: DataFrame, text: Column, columns: list[str]) -> DataFrame:
    out = df.withColumn("_new", text).withColumn("changed", F.col("_new") != F.col("content"))
    return out.withColumn("content", F.col("_new")).select(*columns, "changed")
